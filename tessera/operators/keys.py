"""Column names that all operators share."""

S1, CAND = "source1_entity_id", "candidate_entity_id"
PAIR = [S1, CAND]
