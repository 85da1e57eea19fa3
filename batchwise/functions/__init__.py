"""Column expressions: text cleaning, tokenizing, hashing, stop words, schedule predicates."""
