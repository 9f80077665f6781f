"""Plans put together from operators."""
