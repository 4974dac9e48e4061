"""Whole jobs made of operators: query specs, dashboards, role-based KPIs."""
