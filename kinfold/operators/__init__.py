"""Set operators over records, memberships, pairs and the ledger."""
