"""Plans: the extracts, their plain forms, KPI tables, report tables and the
single-operator queries."""
