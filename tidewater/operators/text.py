"""Text processing: redaction, flags, normalising, near-dup and duplicate clusters, summaries, HTML to Markdown."""

import html.parser
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.scalars import slugify, token_estimate
from ..registry import query
from ..sources.tables import table

# Redaction rules in their order (pattern, mark).
REDACTIONS = (
    (r"(?i)\b(?:api[_-]?key|secret|token|password|passwd|pwd)\s*[:=]\s*\S[^\r\n]*", "<redacted-credential>"),
    (r"sk-[A-Za-z0-9]{20,}", "<redacted-openai-key>"),
    (r"shppa_[A-Za-z0-9]{20,}", "<redacted-shopify-token>"),
    (r"shpat_[A-Za-z0-9]{20,}", "<redacted-shopify-token>"),
    (r"ghp_[A-Za-z0-9]{20,}", "<redacted-github-token>"),
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "<redacted-private-key>"),
    (r"\beyJ[A-Za-z0-9_\-]{10,4096}\.[A-Za-z0-9_\-]{10,4096}\.[A-Za-z0-9_\-]{10,4096}\b", "<redacted-jwt>"),
    (r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "<redacted-aws-key>"),
    (r"\b[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,253}\.[A-Za-z]{2,24}\b", "<redacted-email>"),
    (r"(?is)<think>.*?</think>|<thinking>.*?</thinking>", "<redacted-hidden-reasoning>"),
    (r"(?i)\b(?:chain of thought|chain-of-thought|internal reasoning|private thoughts):[^\n\r]*", "<redacted-hidden-reasoning>"),
)
# Needles of instruction overrides.
INJECTIONS = (
    r"(?i)\bignore\s+(?:all\s+|any\s+)?(?:previous|prior|above|earlier)\s+instructions?\b",
    r"(?i)\bdisregard\s+(?:all\s+|any\s+)?(?:previous|prior|above|earlier)\b",
    r"(?i)\byou\s+are\s+now\b.{0,40}\b(?:dan|do\s+anything\s+now|unrestricted|jailbroken)\b",
    r"(?i)\bnew\s+(?:system\s+)?(?:prompt|instructions?)\s*[:=]",
    r"(?i)<\s*/?\s*(?:system|assistant)\s*>",
    r"(?i)\bsystem\s+override\b",
    r"(?i)\bdeveloper\s+mode\b",
    r"(?i)\boverride\s+(?:your\s+|the\s+)?(?:safety|guard\s*rails?|instructions?)\b",
)
# Tokens of shell injection.
SHELL_TOKENS = (";", "|", "&", "`", "$(", ">", "<", "\n", "\r")
#: A text that none of this is in has nothing to redact; one cheap look spares it all rules.
_ANCHOR = r"(?i)key|secret|token|passw|pwd|sk-|shp|ghp_|eyJ|AKIA|ASIA|@|<think|chain|reasoning|thoughts"


#: Rules with openers and closers: the first character of all their openers, and for each kind a pattern of the rest and of its closer.
SPANS = {
    "<redacted-private-key>": ("-", (("----BEGIN [A-Z ]*PRIVATE KEY-----", "-----END [A-Z ]*PRIVATE KEY-----"),)),
    "<redacted-hidden-reasoning>": ("<", (("(?i:think>)", "(?i:</think>)"), ("(?i:thinking>)", "(?i:</thinking>)"))),
}
#: Stands for the first character of an opener that nothing closes; no character of any text.
_DEAD = "\uffff"


def spans_of(pattern: str, mark: str):
    """Openers and closers of a rule; None for a rule that ends with its line or word."""
    return SPANS.get(mark) if pattern.startswith("(?s)") or pattern.startswith("(?is)") else None


def _replace_spans(text: Column, pattern: str, mark: str, first: str, kinds) -> Column:
    """Replace spans from an opener to its next closer, in time that grows with the text only.

    An opener behind the last closer of its own kind would be followed to the end of the text for nothing, each time anew.
    Such openers are blotted out first, kind by kind, and come back at the end.
    """
    out, some = text, F.lit(False)
    for rest, closer in kinds:
        upto = F.length(F.regexp_extract(out, f"(?s)^(.*{closer})", 1))
        out = F.concat(F.substr(out, F.lit(1), upto), F.regexp_replace(F.substr(out, upto + 1), f"{first}(?={rest})", _DEAD))
        some |= F.rlike(text, F.lit(first + rest))
    return F.when(some, F.translate(F.regexp_replace(out, pattern, mark), _DEAD, first)).otherwise(text)


def redact(text: Column) -> Column:
    out = text
    for pattern, mark in REDACTIONS:
        spans = spans_of(pattern, mark)
        out = F.regexp_replace(out, pattern, mark) if spans is None else _replace_spans(out, pattern, mark, *spans)
    return F.when(F.rlike(text, F.lit(_ANCHOR)), out).otherwise(text)


def is_prompt_injection(text: Column) -> Column:
    hit = F.lit(False)
    for pattern in INJECTIONS:
        hit = hit | F.rlike(text, F.lit(pattern))
    return F.coalesce(hit, F.lit(False))


def is_shell_injection(text: Column) -> Column:
    """True for any shell token; null is not a string and so suspect."""
    hit = F.lit(False)
    for token in SHELL_TOKENS:
        hit = hit | F.contains(text, F.lit(token))
    return F.coalesce(hit, F.lit(True))


def _sql_text(pattern: str) -> str:
    return pattern.replace("'", "''")


_REDACT_SQL = "text"
for _pattern, _mark in REDACTIONS:
    if "{1,253}" in _pattern or "4096" in _pattern:  # repeats that the other engine's regex cannot hold
        _pattern = _pattern.replace("{10,4096}", "{10,}").replace("{1,253}", "+").replace("{1,64}", "+").replace("{2,24}", "{2,}")
    _REDACT_SQL = f"regexp_replace({_REDACT_SQL}, '{_sql_text(_pattern)}', '{_mark}', 'g')"


@query("redacted_documents", f"SELECT doc_id, md5({_REDACT_SQL}) AS digest, CAST(length({_REDACT_SQL}) AS BIGINT) AS n FROM documents")
def redacted_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", redact(F.col("text")).alias("r")).select("doc_id", F.md5("r").alias("digest"), F.length("r").cast("long").alias("n"))


@query(
    "injection_flags",
    "SELECT conv_id, turn, " + " OR ".join(f"regexp_matches(text, '{_sql_text(p)}')" for p in INJECTIONS) + " AS prompt_injection, " + " OR ".join(f"contains(text, {'chr(10)' if t == chr(10) else 'chr(13)' if t == chr(13) else repr(t)})" for t in SHELL_TOKENS) + " AS shell_injection FROM conversations",
)
def injection_flags(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", is_prompt_injection(F.col("text")).alias("prompt_injection"), is_shell_injection(F.col("text")).alias("shell_injection"))


@query(
    "clean_urls",
    """
    WITH u AS (SELECT page_id, url, CASE WHEN contains(url, '?') THEN list_filter(string_split(substr(url, strpos(url, '?') + 1), '&'), lambda p: NOT regexp_matches(p, '^(utm_[^=]*|fbclid|gclid|dclid|msclkid|mc_cid|mc_eid|igshid)(=|$)')) END AS kept FROM pages)
    SELECT page_id, CASE WHEN kept IS NULL THEN url WHEN len(kept) = 0 THEN substr(url, 1, strpos(url, '?') - 1) ELSE substr(url, 1, strpos(url, '?')) || array_to_string(kept, '&') END AS url FROM u
    """,
)
def clean_urls(spark, sf_dir):
    """URLs without tracking parameters."""
    kept = F.filter(F.split(F.substring_index("url", "?", -1), "&"), lambda p: ~F.rlike(p, F.lit("^(utm_[^=]*|fbclid|gclid|dclid|msclkid|mc_cid|mc_eid|igshid)(=|$)")))
    base = F.substring_index("url", "?", 1)
    out = F.when(~F.contains("url", F.lit("?")), F.col("url")).when(F.size(kept) == 0, base).otherwise(F.concat(base, F.lit("?"), F.array_join(kept, "&")))
    return table(spark, sf_dir, "pages").select("page_id", out.alias("url"))


@query(
    "slugs_and_hashes",
    "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, substr(sha256(p_name), 1, 12) AS id, CAST(ceil(length(p_type) / 4.0) AS BIGINT) AS tokens FROM part",
)
def slugs_and_hashes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", slugify(F.concat_ws(" ", "p_name", "p_type")).alias("slug"), F.left(F.sha2("p_name", 256), F.lit(12)).alias("id"), token_estimate(F.col("p_type")).alias("tokens"))


# the other engine's edit distance counts bytes, so this one has a unit test instead of SQL
@query("head_edit_distance")
def head_edit_distance(spark, sf_dir):
    """Edit distance over the first 120 characters; the tails count by their difference in length."""
    t = table(spark, sf_dir, "conversations").withColumn("prev", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("prev IS NOT NULL")
    n, m = F.length("text"), F.length("prev")
    tail = F.abs(F.greatest(n - 120, F.lit(0)) - F.greatest(m - 120, F.lit(0)))
    distance = F.levenshtein(F.substring("text", 1, 120), F.substring("prev", 1, 120)) + tail
    return t.select("conv_id", "turn", F.round(1 - distance / F.greatest(n, m, F.lit(1)), 6).alias("similarity"))


@query("repeat_stubs", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, sha256(text) ORDER BY turn) > 1 AS stub FROM conversations")
def repeat_stubs(spark, sf_dir):
    """Content seen before in the session becomes a stub."""
    w = Window.partitionBy("conv_id", F.sha2("text", 256)).orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.row_number().over(w) > 1).alias("stub"))


@query("output_deltas", "SELECT user_id, event_id, coalesce(md5(props) = lag(md5(props)) OVER (PARTITION BY user_id, event_type ORDER BY event_id), false) AS unchanged FROM events")
def output_deltas(spark, sf_dir):
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.coalesce(F.md5("props") == F.lag(F.md5("props")).over(w), F.lit(False)).alias("unchanged"))


# ---------------------------------------------------------------- LexRank summary
def sentences(text: str) -> list[str]:
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", text or "") if s.strip()]


def lexrank(text: str, n: int = 3, damping: float = 0.85, rounds: int = 20, tolerance: float = 1e-4) -> str:
    """Extractive summary: up to 6 sentences unchanged, else the best by centrality over TF-ISF cosines, in their order."""
    every = sentences(text)
    if len(every) <= 6:
        return " ".join(every)
    s = every[:200]
    bags = [Counter(re.findall(r"\w+", x.lower())) for x in s]
    df = Counter(w for b in bags for w in b)
    isf = {w: np.log(1 + len(s) / d) for w, d in df.items()}
    index = {w: i for i, w in enumerate(df)}
    x = np.zeros((len(s), len(index)))
    for i, b in enumerate(bags):
        for w, c in b.items():
            x[i, index[w]] = c * isf[w]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    sim = x @ x.T
    np.fill_diagonal(sim, 0)
    total = sim.sum(axis=1, keepdims=True)
    move = np.divide(sim, total, out=np.full_like(sim, 1 / len(s)), where=total > 0)
    rank = np.full(len(s), 1 / len(s))
    for _ in range(rounds):
        new = (1 - damping) / len(s) + damping * move.T @ rank
        done = np.abs(new - rank).sum() < tolerance
        rank = new
        if done:
            break
    want = max(3, min(n, len(text) // 120))
    chosen = [0, 1]
    for i in np.argsort(-rank, kind="stable"):
        if len(chosen) >= want:
            break
        if i not in chosen and s[i] not in {s[j] for j in chosen}:
            chosen.append(int(i))
    return " ".join(s[i] for i in sorted(chosen))


def _lexrank(texts: pd.Series) -> pd.Series:
    return texts.map(lexrank)


@query("lexrank_summaries")
def lexrank_summaries(spark, sf_dir):
    summarise = F.pandas_udf(_lexrank, "string")
    return table(spark, sf_dir, "documents").select("doc_id", summarise("text").alias("summary"))


# ---------------------------------------------------------------- HTML to Markdown
class _Markdown(html.parser.HTMLParser):
    # Elements without content of their own, and block elements.
    DROP = {"script", "style", "noscript", "template", "svg", "iframe", "nav", "footer", "aside", "form", "head"}
    BLOCK = {"p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "br", "blockquote", "pre", "header", "h1", "h2", "h3", "h4", "h5", "h6", "li"}

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.out, self.skip, self.links = base, [], [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.skip or tag in self.DROP or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in (a.get("style") or "").replace(" ", ""):
            if tag not in ("br", "img", "input", "meta", "link", "hr"):
                self.skip.append(tag)
            return
        if tag in self.BLOCK:
            self.out.append("\n")
        if re.fullmatch("h[1-6]", tag):
            self.out.append("#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("- ")
        elif tag == "img" and a.get("alt"):
            self.out.append(a["alt"])
        elif tag == "a":
            from urllib.parse import urljoin

            self.links.append(urljoin(self.base, a.get("href") or ""))
            self.out.append("[")

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                while self.skip.pop() != tag:
                    pass
            return
        if tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag in self.BLOCK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


def html_to_markdown(page: str, base: str = "") -> str:
    parser = _Markdown(base or "")
    parser.feed(page or "")
    parser.close()
    lines = [re.sub(r" {2,}", " ", line).strip() for line in "".join(parser.out).split("\n")]
    out: list[str] = []
    for line in lines:  # neighbours that repeat go, and so do runs of empty lines
        if line and (not out or out[-1] != line):
            out.append(line)
    return "\n\n".join(out)


@query("pages_to_markdown")
def pages_to_markdown(spark, sf_dir):
    # row by row, 100 pages to a batch: an Arrow batch has 10,000, whatever their size
    convert = F.udf(html_to_markdown, "string", useArrow=False)
    return table(spark, sf_dir, "pages").select("page_id", convert("html", "url").alias("markdown"))


def chunk_markdown(text: str, limit: int = 2000) -> list[str]:
    """Blocks between blank lines; table rows stay with their header; blocks over ``limit`` in groups of 20 lines."""
    out = []
    for block in re.split(r"\n\s*\n", text or ""):
        lines = block.strip("\n").split("\n")
        if not block.strip():
            continue
        head = lines[:2] if len(lines) > 2 and lines[0].lstrip().startswith("|") and set(lines[1].strip()) <= set("|-: ") else []
        if len(block) <= limit:
            out.append("\n".join(lines))
        else:
            body = lines[len(head):]
            out += ["\n".join(head + body[i : i + 20]) for i in range(0, len(body), 20)]
    return out


def page_chunks(page: str, base: str = "") -> list[str]:
    return chunk_markdown(html_to_markdown(page, base))


@query("markdown_chunks")
def markdown_chunks(spark, sf_dir):
    """Pages are converted and cut in one worker, row by row as in ``pages_to_markdown``."""
    cut = F.udf(page_chunks, "array<string>", useArrow=False)
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(cut("html", "url")).alias("chunk", "text"))


# ---------------------------------------------------------------- difficulty along a trajectory
def difficulty_states(scores: Column) -> Column:
    """The state after each step of an ordered array of scores: INIT, NORMAL, FAST, SLOW or SKIP.

    NORMAL turns FAST after 6 scores of 0.2 or less and SLOW after 5 of 0.6 or more; FAST ends above 0.3, SLOW and SKIP
    below 0.5; SLOW turns SKIP after 35 of 0.85 or more. Runs are counted along the fold.
    """
    start = F.struct(F.lit("INIT").alias("state"), F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(0).alias("top"), F.array().cast("array<string>").alias("path"))

    def step(a, x):
        low, high, top = (F.when(c, n + 1).otherwise(0) for c, n in ((x <= 0.2, a.low), (x >= 0.6, a.high), (x >= 0.85, a.top)))
        state = (
            F.when(a.state == "INIT", "NORMAL")
            .when((a.state == "NORMAL") & (low >= 6), "FAST").when((a.state == "NORMAL") & (high >= 5), "SLOW")
            .when((a.state == "FAST") & (x > 0.3), "NORMAL").when(a.state.isin("SLOW", "SKIP") & (x < 0.5), "NORMAL")
            .when((a.state == "SLOW") & (top >= 35), "SKIP").otherwise(a.state)
        )
        return F.struct(state.alias("state"), low.alias("low"), high.alias("high"), top.alias("top"), F.concat(a.path, F.array(state)).alias("path"))

    return F.aggregate(scores, start, step)["path"]


@query("difficulty_fsm")
def difficulty_fsm(spark, sf_dir):
    score = F.round(1 / (1 + F.exp(-(F.col("value") - 40) / 20)), 4)
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", score.alias("s")))), lambda x: x.s).alias("scores"))
    return e.select("user_id", F.posexplode(difficulty_states(F.col("scores"))).alias("step", "state")).groupBy("user_id", "state").agg(F.count("*").alias("steps"))


