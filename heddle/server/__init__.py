"""The HTTP endpoint and what it needs: configuration, tokens, reload."""
