"""Column functions: text preparation, JSON repair, scores, prompts."""
