"""DataFrame operators: search, fusion, context scoring, ranking, domain rules, index maintenance."""
