"""Metadata catalog: profiles, classification, key discovery and catalog questions."""
