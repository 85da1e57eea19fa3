"""Fixed values that must equal the reference's (and its library's defaults)
for the results to agree.  Stated plainly, in their natural order, in one
place; every other module imports them from here."""

# The one-character tokens the reference's noise filter drops
# besides the stop words (28 punctuation marks, then the 10 digits).
NOISE_SYMBOLS = (
    "!", "(", ")", "-", "[", "]", "{", "}", ";", ":", "'", '"', "\\", "<", ">",
    ".", ",", "/", "?", "@", "#", "$", "%", "^", "&", "*", "_", "~",
    "1", "2", "3", "4", "5", "6", "7", "8", "9", "0",
)

# The base English stop words of the noise filter, the default
# list of Apache Spark's StopWordsRemover (Apache License 2.0), in its order.
ENGLISH_STOPWORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself",
    "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these",
    "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do",
    "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while",
    "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before",
    "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again",
    "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each",
    "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than",
    "too", "very", "s", "t", "can", "will", "just", "don", "should", "now", "i'll", "you'll", "he'll",
    "she'll", "we'll", "they'll", "i'd", "you'd", "he'd", "she'd", "we'd", "they'd", "i'm", "you're", "he's",
    "she's", "it's", "we're", "they're", "i've", "we've", "you've", "they've", "isn't", "aren't", "wasn't",
    "weren't", "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't", "won't", "wouldn't", "shan't",
    "shouldn't", "mustn't", "can't", "couldn't", "cannot", "could", "here's", "how's", "let's", "ought",
    "that's", "there's", "what's", "when's", "where's", "who's", "why's", "would",
)

# Fixed value: a token is a maximal run of at least two word characters
# (letters, digits, underscore), matched on the lower-cased text.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

# Fixed value: number of hash buckets of the hashed features.
DEFAULT_N_FEATURES = 1 << 20

# Fixed value: additive smoothing of both naive Bayes models.
DEFAULT_ALPHA = 1.0

# L2 strength of the linear model, and the scale of its
# intercept step for sparse input.
DEFAULT_LAMBDA = 1e-4
INTERCEPT_DECAY = 0.01

# Fixed value: the micro-batch interval of the stream.
TRIGGER_INTERVAL = "5 seconds"

# Fixed values: (plan, n_train, n_total) of the reference's four runs
# (batch size 100, 500, 1000, 1500 rows).
REFERENCE_PLANS = (
    ("size100", 303, 336),
    ("size500", 60, 66),
    ("size1000", 30, 33),
    ("size1500", 20, 22),
)
