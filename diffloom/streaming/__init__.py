"""Streaming forms of the stateless stages and the additive scores."""
