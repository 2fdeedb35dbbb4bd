"""Column expressions over text: tokens, entities, query kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Capitalised words that are no entities (fixed values).
ENTITY_STOP = ("the", "and", "for", "that", "this", "with", "from", "have")
#: Groups of synonyms by name, without the names of products (fixed values).
SYNONYMS = {
    "verification": ("verify", "verified", "verification_score", "z3", "formal"),
    "belief": ("belief", "revision", "agm", "contradiction", "conflict"),
    "memory": ("memory", "remember", "recall", "retrieval", "state"),
    "decay": ("decay", "strength", "forgetting", "stale", "prune"),
    "seed": ("seed", "round", "funding", "investor", "cap", "safe"),
    "product": ("product", "protocol", "platform", "service"),
    "reputation": ("reputation", "trust", "agent", "on-chain"),
    "document": ("document", "pdf", "ocr", "tool", "saas"),
    "cfo": ("cfo", "finance", "accounting", "erp"),
    "benchmark": ("benchmark", "score", "evaluation", "longmemeval", "recall"),
}
#: Abbreviations and their long forms (fixed values).
ABBREVIATIONS = {"k8s": "kubernetes", "deploy": "deployment", "infra": "infrastructure", "db": "database", "svc": "service", "cfg": "configuration", "authn": "authentication", "authz": "authorization", "perf": "performance", "obs": "observability"}
#: Words that tell a query's kind, tried in order (fixed values).
QUERY_KINDS = {"temporal": ("when", "before", "after", "first", "order", "timeline"), "causal": ("why", "because", "reason", "cause"), "factual": ("who", "what", "which", "how many"), "relational": ("how", "connect", "relate", "link")}
#: Words that tell what kind of time a query asks for, tried in order (fixed values).
TEMPORAL_KINDS = {
    "when": ("when", "date", "time", "day", "month"),
    "before": ("before", "earlier", "prior", "first"),
    "after": ("after", "later", "following", "then", "last"),
    "duration": ("how long", "duration", "between", "gap", "elapsed"),
    "ordering": ("order", "sequence", "chronolog", "timeline"),
}
#: Words that are no keywords (fixed values).
KEYWORD_STOP = (
    "what", "when", "where", "who", "how", "which", "did", "do", "was", "were", "have", "has", "had", "is", "are", "the", "a", "an", "my", "me", "i", "you", "your", "their", "it",
    "its", "in", "on", "at", "to", "for", "of", "with", "by", "from", "ago", "last", "that", "this", "there", "about", "get", "got", "give", "gave", "buy", "bought", "made",
    "make", "been", "being", "could", "would", "should", "will", "can", "may", "might", "shall", "must", "need", "dare", "ought", "used", "like", "just", "also", "then", "than",
    "more", "very", "much", "many", "some", "any", "every", "each", "both", "few", "other", "another", "such", "even", "still", "already", "yet", "ever", "never", "always",
    "often", "sometimes", "usually", "here", "there", "now", "today", "yesterday", "tomorrow", "really", "actually", "probably", "perhaps", "maybe", "sure", "yes", "no", "not",
)


BM25_TOKEN = "[a-z0-9]{2,}"
QUERY_TOKEN = "[a-z0-9_]+"


def bm25_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(BM25_TOKEN), F.lit(0))


def query_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(QUERY_TOKEN), F.lit(0))


def keywords(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*KEYWORD_STOP)))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[a-zA-Z0-9_]+"))


def entities(text: Column) -> Column:
    """Distinct capitalised words but for a few; word ends as Unicode has them."""
    found = F.regexp_extract_all(text, F.lit(r"(?U)\b[A-Z][A-Za-z0-9_-]{2,}\b"), F.lit(0))
    return F.filter(F.array_distinct(found), lambda w: ~F.lower(w).isin(*ENTITY_STOP))


def key_values(text: Column) -> Column:
    """array<struct<name, value>> of ``name = value`` and ``name: value``."""
    pattern = F.lit(r"([a-z_]+)\s*[=:]\s*([^,\n]+)")
    return F.zip_with(F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)), lambda a, b: F.struct(a.alias("name"), b.alias("value")))


def _first_kind(text: Column, kinds: dict, default: Column) -> Column:
    out = default
    for kind, words in reversed(kinds.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(text), F.lit(w))
        out = F.when(hit, kind).otherwise(out)
    return out


def query_type(text: Column) -> Column:
    return _first_kind(text, QUERY_KINDS, F.lit("general"))


def temporal_type(text: Column) -> Column:
    return _first_kind(text, TEMPORAL_KINDS, F.lit(None).cast("string"))


def temporal_boost(kind: Column, dated: Column) -> Column:
    return F.when(kind.isNull(), 1.0).when(~dated, 0.8).when(kind.isin("when", "before", "after", "ordering"), 1.4).when(kind == "duration", 1.2).otherwise(1.0)


def format_duration(seconds: Column) -> Column:
    days = F.floor(seconds / 86400)
    said = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(f" {unit}"))
    return (
        F.when(seconds < 60, said(seconds, "seconds"))
        .when(seconds < 3600, said(seconds / 60, "minutes"))
        .when(seconds < 86400, said(seconds / 3600, "hours"))
        .when(days < 30, said(days, "days"))
        .when(days < 365, said(days / 30, "months"))
        .otherwise(said(days / 365, "years"))
    )


def expand_query(text: Column) -> Column:
    """The distinct words of a query and of every synonym group that one of them belongs to."""
    words = F.split(F.lower(F.trim(text)), r"\s+")
    none = F.array().cast("array<string>")
    groups = [F.array(*map(F.lit, (key, *group))) for key, group in SYNONYMS.items()]
    return F.array_sort(F.array_distinct(F.concat(words, *[F.when(F.arrays_overlap(words, g), g).otherwise(none) for g in groups])))


def expand_abbreviations(text: Column) -> Column:
    """Tokens in order, each followed by its long form unless that is there already."""
    table = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])

    def step(acc: Column, t: Column) -> Column:
        own = F.concat(acc, F.array(t))
        long = F.try_element_at(table, t)
        return F.when(long.isNotNull() & ~F.array_contains(own, F.coalesce(long, F.lit(""))), F.concat(own, F.array(long))).otherwise(own)

    return F.array_join(F.aggregate(query_tokens(text), F.array().cast("array<string>"), step), " ")
