"""Query plans: the prepared ride tables, the named query catalog and its
SQL oracle, session settings and plan checks."""
