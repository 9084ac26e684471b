"""Leads as they arrive."""
