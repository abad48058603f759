"""Reading files, typing and deduplicating them, and the ledgers around that."""
