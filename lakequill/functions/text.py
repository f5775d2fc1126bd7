"""Text functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Contractions and their expansions, replaced in this order.
CONTRACTIONS = {
    "what's": "what is", "what're": "what are", "where's": "where is", "when's": "when is", "who's": "who is", "how's": "how is",
    "don't": "do not", "doesn't": "does not", "didn't": "did not", "won't": "will not", "wouldn't": "would not", "shouldn't": "should not",
    "can't": "cannot", "couldn't": "could not", "isn't": "is not", "aren't": "are not", "wasn't": "was not", "weren't": "were not",
    "haven't": "have not", "hasn't": "has not", "hadn't": "had not", "i'm": "i am", "you're": "you are", "he's": "he is", "she's": "she is",
    "it's": "it is", "we're": "we are", "they're": "they are", "i've": "i have", "you've": "you have", "we've": "we have",
    "they've": "they have", "i'll": "i will", "you'll": "you will", "we'll": "we will", "they'll": "they will",
}
# One synonym a word for query expansion.
SYNONYMS = {
    "revenue": "income", "profit": "earnings", "cost": "expense", "customer": "client", "product": "item",
    "price": "cost", "increase": "grow", "decrease": "decline", "total": "sum", "average": "mean",
}
# Words that say nothing about a topic.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can need dare ought "
    "what which who when where why how i me my we our you your he she it they them their this that these those "
    "and but or nor for yet so to of in on at by with about as into through from not no any all "
    "please tell explain describe give show find get make use want like know"
).split()
# Phrases of refusals, and of requests for a web search.
REFUSALS = ("I don't know", "I cannot", "I'm not sure", "I don't have information", "I don't have access", "I'm unable to", "no information", "not mentioned in", "not provided in")
REFUSAL_LENGTH = 500
WEB_PHRASES = (
    "check internet", "search internet", "search the internet", "search online", "search the web", "look online", "look it up online",
    "check online", "check the web", "find online", "find on internet", "search web", "google it", "browse the web", "current news",
    "latest news", "recent news", "what's happening", "what is happening", "up to date", "most recent", "most current", "most actual",
    "zoek internet", "zoek het op",
)
# Signals that route a query to a class of models.
VISION = r"(?i)\b(image|diagram|chart|figure|graph|photo|screenshot|picture|visual|what.{0,10}(see|show|depict)|describe.{0,10}image)\b"
CODE = (
    r"(?i)\b(def |class |function |import |from .+ import|return |if __name__|SELECT |INSERT |UPDATE |DELETE |CREATE TABLE|console\.log|print\(|System\.out|#include|<\?php)\b"
    r"|[{};]\s*$|\bcode\b|\bscript\b|\bfunction\b|\bclass\b|\bsyntax\b|\breview.{0,20}(code|script|function)\b|\b(debug|refactor|implement|write a function)\b"
)
FAST_LENGTH = 80


def squeeze(c: Column) -> Column:
    """White space runs made one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def preprocess_query(c: Column) -> Column:
    out = F.lower(squeeze(c))
    for short, full in CONTRACTIONS.items():
        out = F.replace(out, F.lit(short), F.lit(full))
    return squeeze(F.regexp_replace(out, r"[^\p{L}\p{N}_\s\-?.!,]", " "))


def expand_query(c: Column, most: int = 2) -> Column:
    """The query, and up to `most` variants with one word replaced by its synonym, in word order."""
    words = F.filter(F.split(F.lower(c), r"\s+"), lambda w: w.isin(list(SYNONYMS)))
    known = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    variants = F.transform(F.array_distinct(words), lambda w: F.replace(c, w, F.element_at(known, w)))
    return F.concat(F.array(c), F.slice(F.array_except(variants, F.array(c)), 1, most))


def sanitize_query(c: Column, most: int = 5000) -> Column:
    return F.substring(F.regexp_replace(squeeze(c), r"[\x00-\x08\x0B-\x1F]", ""), 1, most)


def sanitize_text(c: Column) -> Column:
    """Tags and control characters dropped, spaces squeezed a line at a time, at most one blank line."""
    out = F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", ""), r"[\x00-\x08\x0B-\x1F]", "")
    lines = F.transform(F.split(out, "\n"), lambda x: squeeze(x))
    return F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")


def sanitize_filename(c: Column, most: int = 255) -> Column:
    """The last path part, with letters, digits, space and ._- alone; unnamed_file if nothing is left."""
    name = F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.\.|\\", "")
    name = F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}_\s.\-]", ""), r"^[. ]+|[. ]+$", "")
    name = F.regexp_replace(name, r"\s+", " ")
    ext = F.regexp_extract(name, r"[^.](\.[^.]*)$", 1)
    name = F.when(F.length(name) > most, F.concat(F.substring(name, F.lit(1), F.lit(most) - F.length(ext)), ext)).otherwise(name)
    return F.when(name == "", "unnamed_file").otherwise(name)


def sanitize_model_name(c: Column, most: int = 100) -> Column:
    return F.substring(F.regexp_replace(F.trim(c), r"[^\p{L}\p{N}_.:\-]", ""), 1, most)


def escape_like(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\%_\[\]])", r"\\$1")


def truncate(c: Column, most: int, suffix: str = "...") -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - len(suffix)), F.lit(suffix))).otherwise(c)


def preview(c: Column, most: int = 200) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def html_to_text(c: Column) -> Column:
    """Scripts and styles dropped, tags made spaces, white space squeezed, then the five XML entities and nbsp decoded."""
    out = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    out = squeeze(F.regexp_replace(out, r"<[^>]+>", " "))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def terms(c: Column) -> Column:
    """Runs of three ASCII letters or more, lower-cased, that aren't stop words."""
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS))


def lexemes(c: Column) -> Column:
    """Lower-cased runs of letters and digits, in order: no stemming, no stop words."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared.cast("double"), (F.size(a) + F.size(b) - shared).cast("double")), F.lit(0.0))


def cjk_ratio(c: Column) -> Column:
    left = F.length(F.regexp_replace(c, "[^一-鿿぀-ゟ゠-ヿ가-힯]", ""))
    return F.coalesce(F.try_divide(left.cast("double"), F.length(c).cast("double")), F.lit(0.0))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s\-]", "")), r"[\s\-]+", "-")


def is_refusal(c: Column) -> Column:
    return (F.length(c) < REFUSAL_LENGTH) & c.rlike("(?i)" + "|".join(REFUSALS))


def wants_web(c: Column) -> Column:
    return F.lower(c).rlike("|".join(p.replace(".", r"\.") for p in WEB_PHRASES))


def model_class(query: Column, hops: Column | None = None, synthesis: Column | None = None, doc_types: Column | None = None) -> Column:
    """VISION, CODE, LARGE, FAST or BASE: the first whose signal is there."""
    hops = F.lit(1) if hops is None else hops
    synthesis = F.lit(False) if synthesis is None else synthesis
    kinds = F.array().cast("array<string>") if doc_types is None else F.transform(doc_types, F.upper)
    has = lambda *k: F.arrays_overlap(kinds, F.array(*[F.lit(x) for x in k]))
    return (
        F.when(has("IMAGE") | query.rlike(VISION), "VISION")
        .when(has("CODE_PYTHON", "CODE_JS", "CODE_TS") | query.rlike(CODE), "CODE")
        .when((hops >= 2) & synthesis, "LARGE")
        .when((F.length(query) <= FAST_LENGTH) & (hops <= 1) & ~synthesis, "FAST")
        .otherwise("BASE")
    )


def json_object(c: Column, schema: str) -> Column:
    """The JSON object that lies between the first { and the last } of a model's answer."""
    return F.from_json(F.regexp_extract(c, r"(?s)\{.*\}", 0), schema)


def query_plan(c: Column) -> Column:
    """Intent, at most three sub-questions, tools, synthesis and hops (1 to 3), with defaults for what is missing."""
    raw = json_object(c, "intent string, sub_questions array<string>, tools array<string>, synthesis_required boolean, estimated_hops int")
    empty = F.array().cast("array<string>")
    return F.struct(
        F.coalesce(raw["intent"], F.lit("")).alias("intent"),
        F.slice(F.coalesce(raw["sub_questions"], empty), 1, 3).alias("sub_questions"),
        F.coalesce(raw["tools"], empty).alias("tools"),
        F.coalesce(raw["synthesis_required"], F.lit(False)).alias("synthesis_required"),
        F.greatest(F.lit(1), F.least(F.lit(3), F.coalesce(raw["estimated_hops"], F.lit(1)))).alias("estimated_hops"),
    )
