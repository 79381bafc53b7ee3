"""The stateless operators on streams of new texts."""
