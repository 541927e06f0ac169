"""Contracts for JSON and wire data, compiled once and run as Spark plans."""
