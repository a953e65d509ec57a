"""Composed jobs: what a user runs over stored responses."""
