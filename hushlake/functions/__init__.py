"""Column-level building blocks: arrays, variants, text and labels."""
