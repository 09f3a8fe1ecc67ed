"""The query registry: every operator on the supplied tables, with its SQL check."""
