"""The analyses: counting, laws, indices, trends, tagging, groups, contingency, networks, benchmarking."""
