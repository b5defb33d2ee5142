"""Requests and registered queries."""
