"""Column functions: text, identifiers, tokens and packed lists."""
