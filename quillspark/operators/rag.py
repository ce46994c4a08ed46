"""Context for prompts: token budgets, formatting, conversations."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import CATEGORIES, extension, strip, terms, tokens_estimate, truncate_to_tokens
from .tables import materialise


def budget(entries: DataFrame, most: int, header: int) -> DataFrame:
    """Entries (query_id, rank, entry) that fit: a prefix by rank, the first that does not fit cut short if over
    100 tokens are left after a buffer of 50, then none. Tokens never fall, so a running sum decides."""
    rows = entries.withColumn("t", tokens_estimate(F.col("entry"), 4))
    run = F.sum("t").over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("c", run).withColumn("left", most - header - (F.col("c") - F.col("t")))
    fits = header + F.col("c") <= most
    cut = ~fits & (F.col("left") >= 0) & (F.col("left") - 50 > 100)
    rows = rows.where(fits | cut)
    text = F.when(header + F.col("c") <= most, F.col("entry")).otherwise(truncate_to_tokens(F.col("entry"), F.col("left") - 50))
    return rows.select("query_id", "rank", text.alias("entry"))


def last_user_turns(chats: DataFrame) -> DataFrame:
    users = chats.where("role = 'user'")
    return users.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("prompt"))


def replace_last_user(chats: DataFrame, prompts: DataFrame) -> DataFrame:
    """``chats`` with the text of each last user turn replaced (``prompts``: conv_id, turn, enriched)."""
    rows = chats.join(prompts, ["conv_id", "turn"], "left")
    own = F.col("role") == "user"
    return rows.withColumn("text", F.when(own & F.col("enriched").isNotNull(), F.col("enriched")).otherwise(F.col("text"))).drop("enriched")


def with_system(chats: DataFrame, context: str) -> DataFrame:
    """The context goes before the first system turn of a conversation, or becomes a turn -1 where there is none."""
    first = W.partitionBy("conv_id")
    rows = chats.withColumn("_s", F.min(F.when(F.col("role") == "system", F.col("turn"))).over(first))
    mine = (F.col("role") == "system") & (F.col("turn") == F.col("_s"))
    text = F.when(mine, F.concat(F.lit(context + "\n\n"), F.col("text"))).otherwise(F.col("text"))
    lacking = rows.where("_s is null").select("conv_id").distinct()
    new = lacking.select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), F.lit(context).alias("text"))
    return rows.select("conv_id", "turn", "role", text.alias("text")).unionByName(new)


def sessions(chats: DataFrame) -> DataFrame:
    return chats.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(F.col("role") == "user").alias("user_messages"), F.sum(F.length("text")).alias("chars")
    )


def even_sample(chunks: DataFrame, n: int) -> DataFrame:
    """At most ``n`` chunks of each document, evenly spaced in order: those at floor(i * total_chunks / n), with
    the step as a double. A chunk's i is the quotient of its index and the step, or a neighbour of it."""
    step, k = F.col("total_chunks").cast("double") / n, F.col("chunk_index")
    near = F.array(*(F.floor(k / step) + d for d in (-1, 0, 1)))
    taken = F.exists(near, lambda i: (i >= 0) & (i < n) & (F.floor(i.cast("double") * step) == k))
    return chunks.where((F.col("total_chunks") <= n) | taken)


def grouped_parts(chunks: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, part, text: the chunks of a document joined in groups, the first half of a summary by parts."""
    rows = chunks.groupBy("doc_id", F.floor(F.col("chunk_index") / size).cast("int").alias("part"))
    return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "\n\n").alias("text"))


def flatten_parts(parts: Column) -> Column:
    """The text parts of a multimodal message (array of type, text), a line each."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")


def attachments(chats: DataFrame) -> DataFrame:
    """conv_id, attached: texts of the user's multimodal turns (conv_id, turn, role, parts) before the last user
    turn, in order. Conversations without any have no row."""
    users = chats.where("role = 'user'")
    last = users.groupBy("conv_id").agg(F.max("turn").alias("last"))
    rows = users.where("parts is not null").join(last, "conv_id").where("turn < last")
    rows = rows.select("conv_id", "turn", strip(flatten_parts(F.col("parts"))).alias("text")).where("text <> ''")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return rows.groupBy("conv_id").agg(F.array_join(texts, "\n\n---\n\n").alias("attached"))


def routes(bases: DataFrame, suffixes: DataFrame) -> DataFrame:
    """name, real, enabled of every base (base, real) with every suffix (suffix, enabled): configuration tables."""
    name = F.concat_ws("-", "base", "suffix")
    return bases.crossJoin(suffixes).select(name.alias("name"), "real", "enabled")


def resolve(requests: DataFrame, known: DataFrame) -> DataFrame:
    """``requests`` (name) with real, enabled, routed; a name that is no route stands for itself, enabled."""
    rows = requests.join(known, "name", "left").withColumn("routed", F.col("real").isNotNull())
    return rows.withColumns({"real": F.coalesce("real", "name"), "enabled": F.coalesce("enabled", F.lit(True))})


def relevant(ranked: DataFrame, limit: int, least: float) -> DataFrame:
    """Of each query's rows (query_id, id, score, rank) the first ``limit`` whose score is at least ``least``, with
    rank counted anew."""
    order = W.partitionBy("query_id").orderBy("rank", "id")
    rows = ranked.where(F.col("score") >= least).withColumn("rank", F.row_number().over(order))
    return rows.where(F.col("rank") <= limit)


def chunk_context(found: DataFrame, chunks: DataFrame, limit: int = 5, least: float = 0.3) -> DataFrame:
    """``relevant`` chunks (found: query_id, id = chunk_id, score, rank) with the columns of ``chunks`` and
    ``documents``, how many distinct documents the query's chunks come from."""
    rows = relevant(found, limit, least).withColumnRenamed("id", "chunk_id").join(chunks, "chunk_id")
    seen = F.size(F.collect_set("doc_id").over(W.partitionBy("query_id")))
    return rows.withColumns({"documents": seen.cast("int"), "score": F.round("score", 4)})


def percent(score: Column) -> Column:
    return F.concat(F.bround(100 * score, 0).cast("int").cast("string"), F.lit("%"))


def entry(rank: Column, title: Column, path: Column, score: Column, content: Column, part: Column | None = None, category: Column | None = None) -> Column:
    """One numbered entry of a context: title (and part n/m), then path, category and relevance as far as they are
    given, then the content, a line each."""
    line = lambda head, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"    {head}: "), value))
    head = F.concat(F.lit("["), rank.cast("string"), F.lit("] "), title, F.lit("") if part is None else F.concat(F.lit(" "), part))
    shown = F.when(score > 0, percent(score))
    middle = [line("Path", path), *([] if category is None else [line("Category", category)]), line("Relevance", shown)]
    return F.concat_ws("\n", head, *middle, line("Content", content))


def contexts(entries: DataFrame, head: Column, most: int, header_tokens: int) -> DataFrame:
    """query_id, context, entries, tokens: each query's entries (query_id, rank, entry, and what ``head`` reads)
    within the budget, joined by blank lines below ``head``."""
    kept = budget(entries, most, header_tokens)
    joined = kept.groupBy("query_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "entry"))), lambda x: x["entry"]), "\n\n").alias("body"),
        F.count("entry").alias("entries"),
    )
    heads = entries.groupBy("query_id").agg(F.first(head).alias("head"))
    rows = joined.join(heads, "query_id").withColumn("context", F.concat_ws("\n\n", "head", "body"))
    return rows.select("query_id", "context", "entries", tokens_estimate(F.col("context"), 4).alias("tokens"))


def enrich(prompts: DataFrame, chunk_contexts: DataFrame, document_contexts: DataFrame, instruction: str | None = None) -> DataFrame:
    """query_id, mode (chunks, documents or none), enriched: the context of chunks, else that of documents, before
    the prompt (query_id, prompt), an instruction before both."""
    rows = prompts.join(chunk_contexts.select("query_id", F.col("context").alias("_c")), "query_id", "left")
    rows = rows.join(document_contexts.select("query_id", F.col("context").alias("_d")), "query_id", "left")
    mode = F.when(F.col("_c").isNotNull(), "chunks").when(F.col("_d").isNotNull(), "documents").otherwise("none")
    parts = [F.lit(instruction).cast("string"), F.coalesce("_c", "_d"), F.col("prompt")]
    return rows.select("query_id", mode.alias("mode"), F.concat_ws("\n\n", *parts).alias("enriched"))


def system_texts(profiles: DataFrame) -> DataFrame:
    """profile_id, context of configuration rows (identity, user, folders: array); what is blank is left out."""
    given = lambda c: F.nullif(strip(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    listed = F.when(F.size("folders") > 0, F.concat(F.lit("Indexed folders:\n"), F.array_join(F.transform("folders", lambda x: F.concat(F.lit("- "), x)), "\n")))
    return profiles.select("profile_id", F.concat_ws("\n\n", given("identity"), F.concat(F.lit("User: "), given("user")), listed).alias("context"))


#: Signs that a word may end with and still be read whole: everything else but letters and digits is left out.
_WORD_END = r"[^\p{L}\p{N}_]+$"


def _words(prompt: Column, between: str = r"(?U)\s+") -> Column:
    return F.filter(F.split(F.coalesce(prompt, F.lit("")), between), lambda w: w != "")


def prompt_path(prompt: Column, home: str = "/home/user") -> Column:
    """The first path among the words of a prompt, null if none. A path starts at the root, at a home folder or at a
    drive, maybe within a quotation or brackets, goes on for at least one character, and ends with a letter or digit."""
    bare = lambda w: F.regexp_replace(F.regexp_replace(w, r"^[\p{Ps}\p{Pi}\"']+", ""), _WORD_END, "")
    sign = lambda w, i: F.substring(w, i, 1).isin("/", "\\")

    def is_path(w: Column) -> Column:
        drive = F.lower(F.substring(w, 1, 1)).between("a", "z") & (F.substring(w, 2, 1) == ":") & sign(w, 3)
        return w.startswith("/") | (w.startswith("~") & sign(w, 2)) | drive

    words = F.transform(_words(prompt, r"(?U)[\s,;]+"), bare)
    found = F.get(F.filter(words, is_path), F.lit(0))
    return F.when(found.startswith("~"), F.concat(F.lit(home), F.substr(found, F.lit(2)))).otherwise(found)


@dataclass
class PathIndex:
    """``paths``: place (from 0, in the order of path), path and other columns; ``bounds``: prefix, low, high: the places of
    the paths that begin with the prefix are those from low to before high."""

    paths: DataFrame
    bounds: DataFrame


def path_index(prefixes: DataFrame, docs: DataFrame) -> PathIndex:
    """The index of ``docs`` (path, and more) for ``prefixes`` (prefix); null ones are left out.

    What begins with a prefix stands together in the order of paths, so a prefix asks for two places in it: its own and
    that of the prefix followed by the last of all characters. Both are sorted among the paths, by one range sort, whose
    partitions count the paths that they hold: no path is repeated, and a prefix of all paths is two rows like any other."""
    asked = prefixes.select("prefix").where("prefix is not null").distinct()
    own = F.struct(*docs.columns).alias("doc")
    rows = docs.where("path is not null").select(F.col("path").alias("key"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("prefix"), own)
    none = F.lit(None).cast(rows.schema["doc"].dataType).alias("doc")
    low = asked.select(F.col("prefix").alias("key"), F.lit(0).alias("kind"), "prefix", none)
    high = asked.select(F.concat("prefix", F.lit("\U0010ffff")).alias("key"), F.lit(2).alias("kind"), "prefix", none)
    rows = rows.unionByName(low).unionByName(high)
    rows = rows.repartitionByRange("key", "kind").sortWithinPartitions("key", "kind").withColumn("at", F.monotonically_increasing_id())
    rows = materialise(docs.sparkSession, rows, "sorted-paths").withColumn("piece", F.shiftright("at", 33))
    before = F.count_if(F.col("kind") == 1).over(W.partitionBy("piece").orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    pieces = rows.groupBy("piece").agg(F.count_if(F.col("kind") == 1).alias("n"))  # a row for each partition of the sort
    pieces = pieces.select("piece", F.coalesce(F.sum("n").over(W.orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = rows.withColumn("before", before).join(F.broadcast(pieces), "piece").withColumn("place", F.col("before") + F.col("base"))
    placed = materialise(docs.sparkSession, placed.select("kind", "prefix", "place", "doc"), "placed-paths")
    bounds = placed.where("kind <> 1").groupBy("prefix").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    return PathIndex(placed.where("kind = 1").select("place", "doc.*"), bounds)


def counts_below(prefixes: DataFrame, docs: DataFrame) -> DataFrame:
    """prefix, n: documents below each prefix, 0 too: the difference of two places."""
    return path_index(prefixes, docs.select("path")).bounds.select("prefix", (F.col("high") - F.col("low")).alias("n"))


def lists_below(prefixes: DataFrame, docs: DataFrame, most: int = 20) -> DataFrame:
    """prefix, place, title, path: the first ``most`` documents (path, title) below each prefix, by path: those of the
    ``most`` places from its first."""
    index = path_index(prefixes, docs.select("path", "title"))
    last = F.least(F.col("high"), F.col("low") + most) - 1
    asked = index.bounds.where("low < high").select("prefix", "low", F.explode(F.sequence("low", last)).alias("at"))
    rows = asked.join(index.paths.withColumnRenamed("place", "at"), "at")
    return rows.select("prefix", (F.col("at") - F.col("low") + 1).cast("int").alias("place"), "title", "path")


#: Words that ask for names rather than for a number, unless a caller has others.
LISTING = ("list", "liste", "show", "montre", "name", "nomme")


def factual_answers(prompts: DataFrame, docs: DataFrame, most: int = 20, listing: tuple[str, ...] = LISTING) -> DataFrame:
    """prompt_id, answer of prompts (prompt_id, prompt): a list or a count of the documents (path, title) below the
    path that the prompt names; null if it names none. A prompt with a word of ``listing`` asks for a list."""
    wants = F.arrays_overlap(terms(F.col("prompt")), F.array(*map(F.lit, listing)))
    asked = prompts.select("prompt_id", prompt_path(F.col("prompt")).alias("prefix"), wants.alias("wants"))
    shown = F.struct("place", F.concat(F.lit("- "), "title", F.lit(" ("), "path", F.lit(")")).alias("line"))
    lists = lists_below(asked.where("wants"), docs, most).groupBy("prefix").agg(F.sort_array(F.collect_list(shown)).alias("shown"))
    rows = asked.join(counts_below(asked, docs), "prefix", "left").join(lists, "prefix", "left")
    where = F.concat(F.lit(" under "), "prefix")
    lines = F.array_join(F.transform("shown", lambda x: x["line"]), "\n")
    answer = (
        F.when(F.col("prefix").isNull(), None).when(F.col("n") == 0, F.concat(F.lit("no documents"), where))
        .when(F.col("wants"), F.concat(F.least(F.col("n"), F.lit(most)).cast("string"), F.lit(" listed"), where, F.lit("\n"), lines))
        .otherwise(F.concat(F.col("n").cast("string"), F.lit(" documents"), where))
    )
    return rows.select("prompt_id", answer.alias("answer"))


#: Marks that a title may stand between.
QUOTES = (('"', '"'), ("«", "»"), ("“", "”"))
#: Extensions of documents, beginnings of words that ask for a summary, and words between these and a title.
NAMED = CATEGORIES["document"] + CATEGORIES["presentation"] + CATEGORIES["text"] + (".epub",)
WISHES = ("summar", "résum", "synthé")
BETWEEN = ("of", "de", "du", "des", "me", "moi")


def _quoted(prompt: Column) -> Column:
    """What the first pair of quotation marks holds."""
    some = [F.struct(F.instr(prompt, a).alias("at"), F.regexp_extract(prompt, f"{a}([^{b}]+){b}", 1).alias("text")) for a, b in QUOTES]
    return F.array_min(F.filter(F.array(*some), lambda x: x["text"] != ""))["text"]


def _file_name(words: Column, extensions: tuple[str, ...]) -> Column:
    """The first word that ends like a file, and the words before it back to a sign other than a hyphen."""
    bare = F.transform(words, lambda w: F.regexp_replace(w, _WORD_END, ""))
    at = F.array_position(F.transform(bare, lambda w: extension(w).isin(*extensions)), True).cast("int")
    stops = F.filter(F.sequence(F.lit(1), F.greatest(at - 1, F.lit(1))), lambda i: (i < at) & F.get(words, i - 1).rlike(r"[^\p{L}\p{N}_-]$"))
    first = F.coalesce(F.array_max(stops), F.lit(0)) + 1
    name = F.concat_ws(" ", F.slice(words, first, at - first), F.get(bare, at - 1))
    return F.when(at > 0, F.regexp_replace(name, r"^[^\p{L}\p{N}_]+", ""))


def _wished(words: Column, wishes: tuple[str, ...], between: tuple[str, ...]) -> Column:
    """What follows the first word that asks for a summary."""
    asks = lambda w: reduce(lambda a, b: a | b, (F.lower(w).startswith(x) for x in wishes))
    at = F.array_position(F.transform(words, asks), True).cast("int")
    rest = F.slice(words, at + 1, F.size(words))
    rest = F.when(F.lower(F.get(rest, F.lit(0))).isin(*between), F.slice(rest, F.lit(2), F.size(words))).otherwise(rest)
    return F.when(at > 0, F.regexp_replace(F.array_join(rest, " "), _WORD_END, ""))


def document_name(prompt: Column, extensions: tuple[str, ...] = NAMED, wishes: tuple[str, ...] = WISHES, between: tuple[str, ...] = BETWEEN) -> Column:
    """The document that a prompt is about: what stands in quotation marks, else a file name, else what follows a
    wish for a summary; null if none."""
    some = lambda c: F.nullif(strip(c), F.lit(""))
    words = _words(prompt)
    return F.coalesce(some(_quoted(prompt)), some(_file_name(words, extensions)), some(_wished(words, wishes, between)))


def resolve_documents(named: DataFrame, ranked: DataFrame, docs: DataFrame, most: int = 5) -> DataFrame:
    """query_id, id: of the first ``most`` hits of a name (query_id, name) the first whose title or path holds it in
    any case, else the first. ``ranked``: query_id, id, rank; ``docs``: id, title, path."""
    rows = ranked.where(F.col("rank") <= most).join(named, "query_id").join(docs.select("id", "title", "path"), "id")
    held = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lower("name"))
    miss = F.when(held("title") | held("path"), 0).otherwise(1)
    return rows.groupBy("query_id").agg(F.min_by("id", F.struct(miss.alias("miss"), "rank")).alias("id"))


def citations(context: DataFrame) -> DataFrame:
    """query_id, sources: id, title, path and score of a query's context in order, a line each."""
    line = F.struct("rank", F.concat_ws(" | ", F.col("id").cast("string"), "title", "path", F.format_number("score", 4)).alias("line"))
    rows = context.groupBy("query_id").agg(F.sort_array(F.collect_list(line)).alias("x"))
    return rows.select("query_id", F.array_join(F.transform("x", lambda s: s["line"]), "\n").alias("sources"))


def summaries(chunks: DataFrame, write: Callable[[Column], Column], size: int = 5, most: int = 100) -> DataFrame:
    """doc_id, parts, summary: at most ``most`` even chunks of a document, ``write`` applied to each group of ``size``
    of them and then to the joined partial summaries. A part that ``write`` gives null for leaves a mark."""
    order = W.partitionBy("doc_id").orderBy("chunk_index")
    rows = even_sample(chunks, most).withColumn("chunk_index", F.row_number().over(order) - 1)
    parts = grouped_parts(rows, size)
    mark = F.concat(F.lit("[part "), (F.col("part") + 1).cast("string"), F.lit(" failed]"))
    parts = parts.select("doc_id", "part", F.coalesce(write(F.col("text")), mark).alias("text"))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda x: x["text"])
    whole = parts.groupBy("doc_id").agg(F.count("part").alias("parts"), F.array_join(texts, "\n\n").alias("text"))
    return whole.select("doc_id", "parts", F.when(F.col("parts") == 1, F.col("text")).otherwise(F.coalesce(write(F.col("text")), F.col("text"))).alias("summary"))


def sentences(text: str, least: int = 20) -> list[str]:
    """A text's sentences; one of fewer than ``least`` characters goes with the next."""
    out: list[str] = []
    held = ""
    for part in re.split(r"(?<=[.!?。！？])\s+|\n+", text):
        held = f"{held} {part.strip()}".strip()
        if len(held) >= least:
            out.append(held)
            held = ""
    return out + [held] if held else out


def centrality(bags: list[Counter], damping: float = 0.85, rounds: int = 50) -> np.ndarray:
    """How central each bag of words is: the stationary shares of a walk over the graph of their cosines."""
    names = {w: i for i, w in enumerate(sorted({w for b in bags for w in b}))}
    x = np.zeros((len(bags), len(names)))
    for i, b in enumerate(bags):
        for w, n in b.items():
            x[i, names[w]] = n
    x *= np.log(1 + len(bags) / np.maximum((x > 0).sum(0), 1))
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
    links = x @ x.T
    np.fill_diagonal(links, 0)
    total = links.sum(1, keepdims=True)
    step = np.where(total > 0, links / np.maximum(total, 1e-12), 1 / len(bags))
    p = np.full(len(bags), 1 / len(bags))
    for _ in range(rounds):
        p = (1 - damping) / len(bags) + damping * (p @ step)
    return p


def central_text(text: str | None, most: int = 3) -> str | None:
    """The ``most`` most central sentences of a text in their order, the first of equals; null for a blank text."""
    found = sentences(text or "")
    if not found:
        return None
    rank = np.round(centrality([Counter(re.findall(r"[^\W_]+", s.lower())) for s in found]), 9)
    best = sorted(sorted(range(len(found)), key=lambda i: (-rank[i], i))[:most])
    return " ".join(found[i] for i in best)


def central_sentences(most: int = 3) -> Callable[[Column], Column]:
    """A writer of ``summaries`` that takes sentences out of the text: a part is a few chunks, and so is their graph."""

    @F.arrow_udf("string")
    def write(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array((central_text(t.as_py(), most) for t in texts), pa.string())
        pa.default_memory_pool().release_unused()

    return write


def timed_sessions(chats: DataFrame) -> DataFrame:
    """conv_id, messages, seconds: of conversations whose turns have a time (ts)."""
    seconds = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    return chats.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.round(seconds / 1e6, 3).alias("seconds"))


def resolve_suffixes(requests: DataFrame, bases: DataFrame, suffixes: DataFrame) -> DataFrame:
    """name, real, enabled, categories, routed: a name that ends with ``-suffix`` (suffix, enabled, categories) after a
    known base (base, real) is routed, by the first suffix in their order (place); others stand for themselves, enabled,
    for all categories. Beginnings and ends of a name meet the two configuration tables by equal keys."""
    cut = F.filter(F.sequence(F.lit(1), F.length("name")), lambda i: F.substr("name", i, F.lit(1)) == "-")
    ways = requests.select("name").distinct().select("name", F.explode(cut).alias("i"))
    ways = ways.select("name", F.left("name", F.col("i") - 1).alias("base"), F.substr("name", F.col("i") + 1).alias("suffix"))
    found = ways.join(bases, "base").join(suffixes, "suffix")
    best = found.groupBy("name").agg(F.min_by(F.struct("real", "enabled", "categories"), "place").alias("way"))
    rows = requests.join(best, "name", "left")
    return rows.select(
        *requests.columns, F.coalesce("way.real", "name").alias("real"), F.coalesce("way.enabled", F.lit(True)).alias("enabled"),
        F.col("way.categories").alias("categories"), F.col("way").isNotNull().alias("routed"),
    )
