"""Rules as data: elements, checks, order."""
