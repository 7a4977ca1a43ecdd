"""Statement files in, rule files in, ledger snapshots in and out, CSV exports out."""
