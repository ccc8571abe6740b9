"""DataFrame operators on trails, change messages, transactions and checkpoints."""
