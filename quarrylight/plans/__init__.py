"""Registered queries: each one a function of (session, folder) with its SQL twin."""
