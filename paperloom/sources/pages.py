"""Article text and sections of web pages. Parsing is per page, so Spark deals pages out as they are stored."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import CHEMISTRY_WORDS, ascii_density, density
from paperloom.functions.urls import domain
from paperloom.session import text_batches
from paperloom.sources.dumps import abstract_chunks

#: Parts that are dropped, and where articles stand, by domain.
DROPPED = ("nav", "header", "footer", "aside", "script", "style", "noscript", ".references", "#references")
SELECTORS = {
    "arxiv.org": (".abstract", "#abs"),
    "ar5iv.org": ("article", ".ltx_document", "body"),
    "pmc.ncbi.nlm.nih.gov": ("#mc_methods", ".jig-ncbiinpagenav-heading", "#methods", ".sec", "article"),
    "chemrxiv.org": (".article-content", "article"),
    "www.mdpi.com": (".html-article-content", "article"),
    "journals.plos.org": ("#artText", "article"),
    "www.frontiersin.org": (".JournalAbstract", "article"),
    "default": ("article", "main", ".article-body", ".paper-content", "#content", "body"),
}
BLOCKS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "tr")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Signs of a section that is wanted.
HEADINGS = re.compile(r"(?i)experimental\s*(?:section|methods?|procedures?)?|materials?\s+and\s+methods?|synthesis\s+of|preparation\s+of|synthetic\s+procedure")
SIGNALS = ("experimental section", "experimental methods", "materials and methods", "synthesis of", "preparation of", "synthetic procedure", "experimental details", "experimental procedures")
MEASURE = re.compile(r"(?i)\b\d+(?:\.\d+)?\s*(?:mg|g|kg|µ?L|mL|mmol|mol|mM|M|°C|hours?|hrs?|minutes?)\b")
VERB = re.compile(r"(?i)\b(?:dissolved|added|mixed|stirred|heated|refluxed|washed|dried|centrifuged|calcined|prepared)\b")
NEXT_HEADING = re.compile(r"^(?:\d+(?:\.\d+)*\.?\s+|[A-Z][A-Za-z ]{2,}:?$)")


def matches(selector: str, tag: str, names: dict[str, str | None]) -> bool:
    if selector[0] == ".":
        return selector[1:] in (names.get("class") or "").split()
    return names.get("id") == selector[1:] if selector[0] == "#" else tag == selector


class Article(HTMLParser):
    """Collects blocks of the page, each with the selectors that hold it."""

    def __init__(self, selectors: tuple[str, ...]) -> None:
        super().__init__(convert_charrefs=True)
        self.selectors, self.open, self.title = selectors, [], []
        self.text: list[tuple[str, frozenset, int, bool]] = []  # text, selectors, block, in <p>
        self.block, self.next = 0, 0
        self.seen: dict[str, int] = {}

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        names = dict(attrs)
        held = {}
        for s in self.selectors:
            if matches(s, tag, names) and s not in self.seen:  # the first element of each selector
                held[s] = self.seen[s] = 1
        if tag in BLOCKS:
            self.next += 1
        self.open.append((tag, any(matches(d, tag, names) for d in DROPPED), frozenset(held), self.next if tag in BLOCKS else 0))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "title":
            self.title.append(data)
        if not data.strip() or any(o[1] for o in self.open):
            return
        block = next((o[3] for o in reversed(self.open) if o[3]), 0)
        inside = frozenset().union(*[o[2] for o in self.open]) if self.open else frozenset()
        self.text.append((data.strip(), inside, block, any(o[0] == "p" for o in self.open)))


def squeezed(parts: list[str]) -> str:
    return re.sub(r"\s+", " ", " ".join(parts)).strip()


def article(html: str, domain_name: str) -> tuple[str, str]:
    """Text, blocks parted by blank lines, and title."""
    selectors = SELECTORS.get(domain_name, SELECTORS["default"])
    page = Article(selectors)
    page.feed(html)
    page.close()
    title = "".join(page.title).strip()
    for s in selectors:
        mine = [t for t in page.text if s in t[1]]
        blocks: dict[int, list[str]] = {}
        for t in mine:
            if t[2]:
                blocks.setdefault(t[2], []).append(t[0])
        out: list[str] = []
        for parts in blocks.values():
            text = squeezed(parts)
            if text and (not out or out[-1] != text):
                out.append(text)
        text = "\n\n".join(out) if out else squeezed([t[0] for t in mine])
        if len(text.split()) > 100:
            return text, title
    blocks = {}
    for t in page.text:
        if t[3]:
            blocks.setdefault(t[2], []).append(t[0])
    return "\n\n".join(b for b in (squeezed(p) for p in blocks.values()) if len(b) > 50), title


def articles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, title, text, n_words, ok): article text; pages of fewer than 100 words aren't ok."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [article(h or "", d or "") for d, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            n = [len(g[0].split()) for g in got]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[0] for g in got], pa.string()), pa.array(n, pa.int32()), pa.array([x >= 100 for x in n], pa.bool_())], names=[id_col, "title", "text", "n_words", "ok"])

    return text_batches(pages.select(id_col, domain(F.col(url_col)).alias("d"), html_col)).mapInArrow(run, f"`{id_col}` long, title string, text string, n_words int, ok boolean")


class Headed(HTMLParser):
    """Runs of text under headings, figures and tables left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[tuple[str, list[str]]] = []
        self.heading: list[str] | None = None
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if re.fullmatch("h[1-6]", tag):
            self.heading = []
        self.skip += tag in ("figure", "table", "script", "style")

    def handle_endtag(self, tag):
        if re.fullmatch("h[1-6]", tag) and self.heading is not None:
            self.parts.append((squeezed(self.heading), []))
            self.heading = None
        self.skip = max(0, self.skip - (tag in ("figure", "table", "script", "style")))

    def handle_data(self, data):
        if self.heading is not None:
            self.heading.append(data)
        elif self.parts and not self.skip and data.strip():
            self.parts[-1][1].append(data.strip())


def headed_sections(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", min_words: int = 50, pattern: re.Pattern = HEADINGS) -> DataFrame:
    """(id, section, text) under headings that match the pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = Headed()
                page.feed(html or "")
                page.close()
                for head, parts in page.parts:
                    text = squeezed([head, *parts])
                    if pattern.search(head) and len(text.split()) >= min_words:
                        out.append((i, head, text))
            cols = zip(*out) if out else ((),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()))], names=[id_col, "section", "text"])

    return text_batches(pages.select(F.col(id_col).cast("long"), html_col)).mapInArrow(run, f"`{id_col}` long, section string, text string")


#: Sections and fallback paragraphs of a page at most, and the density and words that these paragraphs must have.
PAGE_SECTIONS, PAGE_PARAGRAPHS, PARAGRAPH_DENSITY, PARAGRAPH_WORDS = 5, 3, 0.05, 50
BLANK_LINES, SEPARATORS = re.compile(r"\n{2,}"), b"\x1c\x1d\x1e\x1f"


def walked(
    found: DataFrame, id_col: str, min_words: int, vocabulary: list[str] | None, paragraphs: bool, signals: tuple[str, ...] = SIGNALS, measure: re.Pattern = MEASURE, verb: re.Pattern = VERB
) -> DataFrame:
    """(id, section, priority, text, density, n_words) of sections, and with `paragraphs` those of a page without any, as priority 0.

    A walk in a task tells all of these. Densities and words of ASCII texts are counted there, densities only where they
    are needed. Those of other texts are columns: of paragraphs before the walk, of what it gives after it.
    """
    score = lambda c: density(c, vocabulary) if vocabulary is not None else density(c)
    lexicon = frozenset(w.encode() for w in (CHEMISTRY_WORDS if vocabulary is None else vocabulary))
    plain = lambda c: F.octet_length(c) == F.length(c)
    trimmed = F.array_remove(F.transform(F.split("text", BLANK_LINES.pattern), lambda p: F.trim(p)), "")
    given = F.when(~plain("text"), F.transform(trimmed, lambda p: F.when(~plain(p), score(p))))
    rows = found.select(F.col(id_col).cast("long"), "text", given.alias("ds"))

    def walk(ps: list[str], ds: list[float | None] | None) -> Iterator[tuple[int, int, str]]:
        k = 0
        while k < len(ps):
            text = ps[k]
            low, n = text.lower(), len(text.split())
            heading = n <= 25 and any(s in low for s in signals)
            if not (heading or n > 30 and measure.search(text) and verb.search(text)):
                k += 1
                continue
            parts, size, k = [text], n, k + 1
            while k < len(ps) and size < 900:
                t = ps[k]
                if NEXT_HEADING.match(t) and len(t.split()) <= 25:
                    break
                if heading or (ascii_density(t, lexicon) if ds is None or ds[k] is None else ds[k]) > 0.1:
                    parts.append(t)
                    size += len(t.split())
                k += 1
            special = any(s in low for s in ("synthesis of", "preparation of", "synthetic procedure"))
            if size >= min_words:
                yield 4 if special else 3 if heading else 2, size, " ".join(parts)

    def told(text: str | None, ds: list[float | None] | None) -> Iterator[tuple[int, int, str, float | None, int | None]]:
        if text is None:
            return
        split, some = BLANK_LINES.split(text) if "\n\n\n" in text else text.split("\n\n"), False
        for k, (priority, n, whole) in enumerate(walk([t for p in split if (t := p.strip(" "))], ds)):
            some = True
            if not whole.isascii():
                yield k, priority, whole, None, None
                continue
            # In texts, not in bytes, Python takes four separators for white space, which Java doesn't.
            raw = whole.encode()
            yield k, priority, whole, ascii_density(whole, lexicon), n if len(raw.translate(None, SEPARATORS)) == len(raw) else len(raw.split())
        if paragraphs and not some:
            for k, p in enumerate(split):
                if not p.isascii():
                    yield k, 0, p, None, None
                elif (n := len(p.encode().split())) >= PARAGRAPH_WORDS and (d := ascii_density(p, lexicon)) > PARAGRAPH_DENSITY:
                    yield k, 0, p, d, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, *s) for i, text, ds in zip(*(c.to_pylist() for c in batch.columns)) for s in told(text, ds)]
            cols = zip(*out) if out else ((),) * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32()))], names=[id_col, "section", "priority", "text", "density", "n_words"])

    got = text_batches(rows).mapInArrow(run, f"`{id_col}` long, section int, priority int, text string, density double, n_words int")
    return got.withColumns({"density": F.coalesce("density", score(F.col("text"))), "n_words": F.coalesce("n_words", word_count("text"))})


def page_sections(found: DataFrame, id_col: str = "page_id", min_words: int = 50, vocabulary: list[str] | None = None, signals: tuple[str, ...] = SIGNALS, measure: re.Pattern = MEASURE, verb: re.Pattern = VERB) -> DataFrame:
    """(id, section, priority, text, density) of article text: paragraphs from a heading or a procedure on."""
    got = walked(found, id_col, min_words, vocabulary, False, signals, measure, verb).drop("n_words")
    # If a page has sections of the highest priority, only those count.
    top = F.max("priority").over(Window.partitionBy(id_col))
    return got.withColumn("top", top).where((F.col("top") < 4) | (F.col("priority") == 4)).drop("top")


def page_chunks(found: DataFrame, id_col: str = "page_id", min_words: int = 50, vocabulary: list[str] | None = None) -> DataFrame:
    """(id, place, section, text, n_words) of article texts: the best sections of a page, or its densest paragraphs if it has none.

    The best PAGE_SECTIONS by priority and density are taken first; those that are too short then go. Pages are walked
    once, and words are counted before rows are dealt by page, so that texts move only if they are asked for.
    """
    got = walked(found, id_col, 50, vocabulary, True).where((F.col("priority") > 0) | ((F.col("n_words") >= PARAGRAPH_WORDS) & (F.col("density") > PARAGRAPH_DENSITY)))
    # Paragraphs count only if no page of this id has sections; of sections only the highest priority, if it is there.
    top = F.max("priority").over(Window.partitionBy(id_col))
    kept = got.withColumn("top", top).where(F.when(F.col("top") == 4, F.col("priority") == 4).otherwise((F.col("priority") > 0) | (F.col("top") == 0)))
    best = Window.partitionBy(id_col).orderBy(F.desc("priority"), F.desc("density"), "section")
    placed = kept.withColumn("place", F.row_number().over(best)).where(F.col("place") <= F.when(F.col("priority") > 0, PAGE_SECTIONS).otherwise(PAGE_PARAGRAPHS))
    name = F.when(F.col("priority") > 0, "experimental_section").otherwise(F.concat(F.lit("paragraph_"), F.col("section").cast("string")))
    return placed.select(id_col, "place", name.alias("section"), "text", "n_words").where(F.col("n_words") >= min_words)


def word_count(column: str | Column) -> Column:
    return F.size(F.regexp_extract_all(column, F.lit(r"(?U)\S+"), F.lit(0)))


def fulltext_chunks(papers: DataFrame, pages: DataFrame, least: int = 50) -> DataFrame:
    """(ord, section, method, text) of papers with a page (ord, html): its experimental sections, or the abstract where it has none, or no page.

    An abstract of `least` characters or fewer gives nothing.
    """
    sections = headed_sections(pages.withColumn("html", F.coalesce("html", F.lit(""))), "ord", min_words=50).select("ord", "section", F.lit("ARXIV_HTML").alias("method"), "text")
    told = sections.select("ord").distinct()
    return sections.join(papers.select("ord"), "ord", "left_semi").unionByName(abstract_chunks(papers.join(told, "ord", "left_anti"), least))
