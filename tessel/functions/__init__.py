"""Column functions over texts: normalising, numbers, references, tokens, labels and intents."""
