"""Loading from streams, by the same operators."""
