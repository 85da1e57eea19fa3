"""DataFrame-in, DataFrame-out operators: features, naive Bayes, linear model, k-means, evaluation, vocabulary."""
