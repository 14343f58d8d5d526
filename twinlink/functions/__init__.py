"""Column functions: vectors, texts, prompts, answer parsing and time formats."""
