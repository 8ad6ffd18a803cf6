"""Tables and whole flows put together from the operators."""
