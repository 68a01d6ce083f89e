"""Small documents assembled on the driver from the operators' results: scores, plans, comparisons, exports, cards."""
