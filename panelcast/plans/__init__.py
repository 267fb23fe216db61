"""Compositions: the query catalogue, study configs and the six workflows."""
