"""Whole plans: the trade view of the tables, the warehouse build and the query catalog."""
