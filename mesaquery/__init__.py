"""Analytics over agent memory as DataFrame plans: retrieval, temporal facts, graphs, dedup, reports."""
