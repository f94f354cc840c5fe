"""Operations on training text at scale: filters, formats, near-duplicates, tokens."""
