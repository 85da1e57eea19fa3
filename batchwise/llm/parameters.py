"""Production parameters of the registered queries."""

from .url_filter import Rule

# The vocabulary of the token queries; its files belong to the public_tokenizers package.
BPE_FILE = "byte_bpe_50k.tiktoken"


# Shards of the sharding query.
SHARDS = 24


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


# The rules of the URL query.
URL_RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)
# The listed domains: spam names under three suffixes.
LISTED_DOMAINS = tuple(f"{name}.example.{suffix}"
                       for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
                       for suffix in ("com", "net", "org"))
