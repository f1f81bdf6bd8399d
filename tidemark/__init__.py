"""Event-momentum analytics as plain DataFrame-to-DataFrame operators."""
