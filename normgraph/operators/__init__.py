"""Graph operators: similarity joins, metrics, contraction, components, reports."""
