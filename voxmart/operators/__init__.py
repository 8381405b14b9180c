"""DataFrame -> DataFrame operators: cleaning, scoring, facts, marts, ranking, quality."""
