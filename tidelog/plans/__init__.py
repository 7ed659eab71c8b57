"""Composite queries built from the operators; each stays one lazy plan per section."""
