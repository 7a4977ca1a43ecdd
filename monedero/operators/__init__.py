"""DataFrame-to-DataFrame operators on the spending ledger."""
