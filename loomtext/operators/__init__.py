"""DataFrame operators over token ledgers, matches and catalogues."""
