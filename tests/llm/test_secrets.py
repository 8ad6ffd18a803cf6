import hashlib
import random
import re

from kindling.llm import secrets
from kindling.llm.queries import op8_secrets

RULES = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6, 2),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 20, 0),
    "hex": (re.compile(r"[0-9a-f]+"), 24, 0),
}


def brute_force(text):
    """All base spans by running every pattern over everything."""
    out = []
    for n, (kind, (pattern, least, group)) in enumerate(RULES.items()):
        out += [(m.start(), n, m.end(), kind) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [(s, e, k) for s, _, e, k in sorted(out)]


def test_queries_of_the_rules():
    assign, access, hexa, *_ = (secrets.trigram_query(r) for r in secrets.RULES)
    assert access == (((b"aki", b"kia"),),) and hexa == ()
    assert len(assign) == 1 and (b"tok", b"oke", b"ken") in assign[0]
    assert secrets.trigram_query(secrets.Rule("x", "a(bc|[0-9]+)?d", 1)) == ()


def test_candidates_cover_all_matches():
    rng = random.Random(5)
    pieces = ["password", "PassWD", "secret", "api_key", "apikey", "token", "AKIA", "akia", "=", ":", " ", '"', "'", "abc123", "ABCDEFGH12345678", "0123456789abcdef01234567", "é", "ſecret", "🙂", "\n", "ghp_", "x" * 40]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    got = secrets.spans_of(texts)
    for t, spans in zip(texts, got):
        base = [(s, e, secrets.RULES[n].kind) for s, e, n in spans if n < 3]
        assert base == brute_force(t)
        for s, e, n in spans:
            assert secrets.RULES[n].compiled().match(t, s).end() == e
    assert any(n == 3 for spans in got for *_, n in spans)


def test_odd_documents(odd, empty):
    out = secrets.scan_secrets(odd)
    assert out.count() == 13 and out.where("size(spans) > 0").count() == 0 and out.columns == ["doc_id", "spans"]
    assert secrets.scan_secrets(empty).count() == 0


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_secrets(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute_force(texts[r.doc_id])
        kinds = [k for *_, k in base]
        joined = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in RULES)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(r.spans.split(","))


def test_very_many_matches_of_one_text_take_linear_time():
    import time

    text = "é ".join(f"{i:032x}" for i in range(100_000))
    began = time.perf_counter()
    found = [x for x in secrets.spans_of(["", text, "\u20ac" + "0" * 24], secrets.BASE_RULES)]
    assert time.perf_counter() - began < 20
    assert found[0] == [] and len(found[1]) == 100_000
    assert [x[:2] for x in found[1][:3]] == [(0, 32), (34, 66), (68, 100)] and found[1][-1][:2] == (34 * 99_999, 34 * 99_999 + 32)
    assert found[2][0][:2] == (1, 25)
