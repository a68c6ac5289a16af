"""Text normalisation, gates and scores as column expressions. Lexicons are parameters."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vocabularies of the chemistry gate, the density score and the domain choice.
CHEMISTRY_WORDS = (
    "methanol ethanol water acetone chloroform toluene hexane dmso dmf thf acetonitrile sodium potassium calcium magnesium iron zinc titanium copper silver gold platinum"
    " hydroxide chloride sulfate nitrate acetate oxide nanoparticle precursor synthesis"
).split()
UNITS = "mg g kg ml mm mmol mol nm µm wt% vol% °c molar litre liter gram milligram".split()
VERBS = "dissolved stirred heated refluxed filtered washed dried calcined synthesized prepared added mixed centrifuged annealed deposited".split()
NOUNS = "solution mixture precipitate suspension catalyst solvent reactant precursor nanoparticle synthesis reaction compound electrode electrolyte polymer reagent".split()
OFF_DOMAIN = "neutrino muon boson quark telescope luminosity galaxy algorithm neural dataset pixel spacecraft orbital astronomical".split()
DOMAINS = {
    "chemistry": list(dict.fromkeys([*UNITS, *VERBS, *NOUNS])),
    "physics": "quantum particle boson neutrino muon relativity momentum".split(),
    "biology": "cell protein gene dna rna enzyme bacteria organism".split(),
    "cs": "algorithm neural dataset model classifier pixel embedding".split(),
}
EXPERIMENTAL = (
    "synthesis of", "prepared by", "dissolved in", "was added", "was heated", "experimental section", "materials and methods", "synthetic procedure",
    "was stirred", "was filtered", "refluxed", "mmol", "ml of", "g of", "°c for",
)
#: Patterns of a formula and of the density score.
FORMULA = r"(?U)\b[A-Z][a-z]?\d*(?:[A-Z][a-z]?\d*)+\b"
DENSITY = (
    r"(?U)\b[A-Z][a-z]?\d*(?:[A-Z][a-z]?\d*)*\b",
    r"(?iU)\b\d+\.?\d*\s*(?:mg|g|kg|mL|L|mmol|mol|M|wt%|vol%)\b",
    r"(?iU)\b\d+\s*°C\b",
    r"(?iU)\b(?:dissolved|stirred|heated|refluxed|filtered|washed|dried|added|mixed|solution|mixture|suspension|precipitate|catalyst|solvent|reactant)\b",
)
#: What a text must hold for these of the patterns to be looked for.
NEEDED = {1: r"(?U)\d", 2: "°"}
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words(text: Column) -> Column:
    """Parts between white space, none empty."""
    return F.array_remove(F.split(text, r"(?U)\s+"), "")


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens of letters, degree, micro and per cent signs."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-zA-Zµ°%]+"), F.lit(0)))


def hits(found: Column, lexicon: Sequence[str]) -> Column:
    return F.size(F.array_intersect(found, F.array(*map(F.lit, lexicon))))


def gate_score(text: Column, units: Sequence[str] = UNITS, verbs: Sequence[str] = VERBS, nouns: Sequence[str] = NOUNS) -> Column:
    """Weighted hits per hundred words; null below 20 words."""
    found, n = tokens(text), F.size(words(text))
    score = 2 * hits(found, units) + 2 * hits(found, verbs) + hits(found, nouns) + 1.5 * F.regexp_count(text, F.lit(FORMULA))
    return F.when(n >= 20, score / n * 100)


def gate(
    text: Column, threshold: float = 0.3, vocabulary: Sequence[str] = CHEMISTRY_WORDS, units: Sequence[str] = UNITS, verbs: Sequence[str] = VERBS,
    nouns: Sequence[str] = NOUNS, off: Sequence[str] = OFF_DOMAIN,
) -> Column:
    """Whether a text is of the domain: an anchor, a score of at least the threshold, and no other domain in its place."""
    found = tokens(text)
    score, strange = gate_score(text, units, verbs, nouns), hits(found, off)
    anchor = (hits(found, vocabulary) > 0) | (hits(found, units) > 0) | (F.regexp_count(text, F.lit(FORMULA)) > 0) | ((hits(found, nouns) >= 2) & (strange == 0))
    return F.coalesce(anchor & ~((strange > 3) & (score < 1.0)) & (score >= threshold), F.lit(False))


def density(text: Column, vocabulary: Sequence[str] = CHEMISTRY_WORDS) -> Column:
    """Pattern and vocabulary hits per hundred words, 1 at most."""
    all_words = F.regexp_extract_all(text, F.lit(r"(?U)\b\w+\b"), F.lit(0))
    lexicon = F.array(*map(F.lit, vocabulary))
    count = lambda k, p: F.when(F.rlike(text, F.lit(NEEDED[k])), F.regexp_count(text, F.lit(p))).otherwise(0) if k in NEEDED else F.regexp_count(text, F.lit(p))
    patterns = reduce(lambda a, b: a + b, [count(k, p) for k, p in enumerate(DENSITY)])
    listed = lambda ws: F.size(F.filter(ws, lambda w: F.array_contains(lexicon, F.lower(w))))
    share = lambda ws: F.when(F.size(ws) > 0, F.least((patterns * 0.3 + listed(ws) * 0.5) / F.size(ws) * 100, F.lit(1.0))).otherwise(F.lit(0.0))
    # A list of one, so that the words are looked for once.
    return F.get(F.transform(F.array(all_words), share), 0)


#: The words of the last pattern of the density score, and bytes as parts of words: lower case, or spaces between words.
PROCESS_WORDS = frozenset(w.encode() for w in re.search(r"\(\?:([a-z|]+)\)", DENSITY[3])[1].split("|"))
WORD_BYTES = bytes(ord(chr(b).lower()) if re.match(r"\w", chr(b), re.ASCII) else 32 for b in range(256))
#: The first two patterns, their first character ahead of the test of what stands before it, so that a search can skip to it.
ASCII_DENSITY = (
    re.compile(r"[A-Z](?<=\b[A-Z])[a-z]?\d*(?:[A-Z][a-z]?\d*)*\b", re.ASCII),
    re.compile(r"\d(?<=\b\d)\d*\.?\d*\s*(?:mg|g|kg|mL|L|mmol|mol|M|wt%|vol%)\b", re.ASCII | re.IGNORECASE),
)


def ascii_density(text: str, vocabulary: frozenset[bytes]) -> float:
    """What `density` gives for a text of ASCII characters; others are left to it, since Java and Python differ in what a word is."""
    raw = text.encode("ascii")
    words = raw.translate(WORD_BYTES).split()
    if not words:
        return 0.0
    found = list(filter((vocabulary | PROCESS_WORDS).__contains__, words))
    patterns = sum(w in PROCESS_WORDS for w in found)
    if raw.lower() != raw:
        patterns += sum(1 for _ in ASCII_DENSITY[0].finditer(text))
    if len(raw.translate(None, b"0123456789")) < len(raw):
        patterns += sum(1 for _ in ASCII_DENSITY[1].finditer(text))
    return min((patterns * 0.3 + sum(w in vocabulary for w in found) * 0.5) / len(words) * 100, 1.0)


def vocabulary_union(*lexicons: Sequence[str]) -> list[str]:
    """All words of the lexicons, each once, in order."""
    return list(dict.fromkeys(w for lexicon in lexicons for w in lexicon))


def experimental(text: Column, signals: Sequence[str] = EXPERIMENTAL) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(s.lower())) for s in signals])


def domain(text: Column, lexicons: dict[str, Sequence[str]] = DOMAINS) -> Column:
    """The domain with most distinct hits, the first listed on ties; unknown without any."""
    found = tokens(text)
    best = F.array_max(F.array(*[F.struct(hits(found, lex).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, lex) in enumerate(lexicons.items())]))
    return F.when(best["n"] == 0, "unknown").otherwise(best["name"])


def normalize_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(title), PUNCTUATION, " " * len(PUNCTUATION)), r"(?U)\s+", " "))


def normalize_doi(doi: Column) -> Column:
    out = F.lower(F.trim(doi))
    for prefix in ("^https?://(?:dx\\.)?doi\\.org/", "^doi:\\s*", "^doi\\.org/"):
        out = F.regexp_replace(out, prefix, "")
    return F.nullif(F.trim(out), F.lit(""))


def dedup_key(doi: Column, title: Column) -> Column:
    return F.coalesce(F.concat(F.lit("doi:"), doi), F.concat(F.lit("title:"), F.substring(F.md5(F.lower(F.trim(title))), 1, 12)))


def chunk_id(key: Column, section: Column) -> Column:
    return F.substring(F.sha2(F.concat(key, F.lit("::"), F.lower(F.trim(section))), 256), 1, 16)


def inverted_index(ws: Column) -> Column:
    """Positions of each word of a list, in order: words are sorted with their places, and each run is a word's entry."""

    def runs(pairs: Column) -> Column:
        starts = F.filter(F.transform(pairs, lambda x, k: F.when((k > 0) & (F.get(pairs, k - 1)["w"] == x["w"]), -1).otherwise(k)), lambda k: k >= 0)
        entry = lambda s, end: F.struct(F.get(pairs, s)["w"].alias("w"), F.transform(F.slice(pairs, s + 1, end - s), lambda x: x["p"]).alias("ps"))
        return F.get(F.transform(F.array(starts), lambda ss: F.transform(ss, lambda s, k: entry(s, F.coalesce(F.get(ss, k + 1), F.size(pairs))))), 0)

    placed = F.array_sort(F.transform(ws, lambda w, k: F.struct(w.alias("w"), k.alias("p"))))
    return F.map_from_entries(F.get(F.transform(F.array(placed), runs), 0))


def abstract_from_index(index: Column) -> Column:
    """Words of an inverted index (word -> positions) in the order of their positions."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def title_case(text: Column) -> Column:
    """Upper case after every character that isn't a letter."""
    parts = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(p.substr(F.lit(2), F.length(p))))), "")


def token_estimate(given: Column, made: Column) -> Column:
    n = F.size(words(F.coalesce(given, F.lit("")))) + F.size(words(F.coalesce(made, F.lit(""))))
    return F.greatest(F.lit(1), F.floor(n * 1.3).cast("int"))


def file_name(name: Column) -> Column:
    """A name without marks that file systems or links give a meaning, 100 characters at most."""
    out = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*.()\[\]]+', "_"), r"(?U)\s+", "_")
    return F.substring(F.regexp_replace(F.regexp_replace(out, r"_+", "_"), r"^_|_$", ""), 1, 100)
