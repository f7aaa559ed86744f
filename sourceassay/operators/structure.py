"""Lines, statements, blocks and declarations of source files.

Everything is computed inside the file's row with array functions: splitting a
text into statements, numbering their lines and pairing their braces needs no
shuffle, so only what a later filter keeps ever leaves the row.

The reading is lexical.  Comments are blanked with their line breaks kept;
``;``, ``{`` and ``}`` inside literals, call options (``.call{...}(``) and object
literals do not split.  Python is cut into logical lines, its blocks follow the
indentation.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceassay.functions import text as tx

# Control characters that mark line numbers and cuts; sources lose them first.
_ON, _OFF, _CUT = "\x01", "\x02", "\x03"
_MARK = rf"{_ON}(\d+){_OFF}"
# Stand-ins for delimiters that do not split.
_DELIMITERS = ";{}()[]"
_HELD = "\x04\x05\x06\x07\x08\x0e\x0f"
_SCRIPT = ("js", "jsx", "ts", "tsx")
_HOLD = {d: h for d, h in zip(_DELIMITERS, _HELD)}


def _bracketed(depth: int) -> str:
    """Text between matching brackets, nested up to ``depth``; then anything else."""
    plain = r"[^()\[\]{}]"
    group = rf"[(\[{{]{plain}*+[)\]}}]"
    for _ in range(depth - 1):
        group = rf"[(\[{{](?:{plain}++|{group})*+[)\]}}]"
    return rf"(?s){group}|{plain}++|."


_BRACKETED = _bracketed(6)


def explode_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per physical line, numbered from 1; trailing empty lines are kept.

    The outer form spares the optimizer's ``size(split(...)) > 0`` filter, which
    would split every text a second time.
    """
    keep = [c for c in files.columns if c not in (content, "raw")]
    return files.select(
        *keep, F.posexplode_outer(F.split(content, "\n")).alias("pos", "text")
    ).select(*keep, (F.col("pos") + 1).alias("line"), "text")


def code_text(content: Column, language: Column) -> Column:
    """The text with comments blanked; every line keeps its number."""
    def blank(t: Column) -> Column:
        return F.regexp_replace(t, r"[^\n]+", " ")

    def starts(t: Column, *heads: str) -> Column:
        test = F.startswith(t, F.lit(heads[0]))
        for h in heads[1:]:
            test = test | F.startswith(t, F.lit(h))
        return test

    def held(t: Column) -> Column:
        return F.translate(t, _DELIMITERS, _HELD)

    marks = _ON + _OFF + _CUT + _HELD
    clean = F.when(content.rlike(f"[{marks}]"), F.translate(content, marks, " " * len(marks))
                   ).otherwise(content)
    c_like = F.transform(
        tx.tokens(clean, tx.CODE_TOKENS),
        lambda t: F.when(starts(t, "//", "/*"), blank(t))
        .when(starts(t, '"', "'", "`") | (starts(t, "/") & (F.length(t) > 1)), held(t))
        .otherwise(t),
    )
    python = F.transform(
        tx.tokens(clean, tx.PY_TOKENS),
        lambda t: F.when(starts(t, "#"), blank(t)).when(starts(t, '"', "'"), held(t)).otherwise(t),
    )
    return F.array_join(F.when(language == "py", python).otherwise(c_like), "")


def _hold_inner(code: Column, language: Column) -> Column:
    """Hold back delimiters that belong to an expression."""
    o, c, semi = _HOLD["{"], _HOLD["}"], _HOLD[";"]
    options = F.regexp_replace(code, r"(\.\s*\w+\s*)\{([^{}]*)\}(?=\s*\()", f"$1{o}$2{c}")
    literals = code
    for _ in range(3):  # object literals, innermost first
        literals = F.regexp_replace(
            literals, r"([(,=:\[?]\s*|\breturn\s+)\{([^{};]*)\}", f"$1{o}$2{c}"
        )
    held = F.when(language == "sol", options).when(language.isin(*_SCRIPT), literals).otherwise(code)
    return F.regexp_replace(held, r"(\bfor\s*\([^;()]*);([^;()]*);", f"$1{semi}$2{semi}")


def _numbered(code: Column, cut: bool) -> Column:
    """Lines with their number in front and, if asked, behind every cut."""
    def mark(line: Column, i: Column) -> Column:
        number = F.concat(F.lit(_ON), (i + 1).cast("string"), F.lit(_OFF))
        if cut:
            line = F.regexp_replace(
                line, F.lit("([;{}])"), F.concat(F.lit("$1" + _CUT), number)
            )
        return F.concat(number, line)

    return F.transform(F.split(code, "\n"), mark)


def _swap(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def pieces(content: Column, language: Column) -> Column:
    """Raw statements (with line marks) in source order, empty ones left out."""
    code = code_text(content, language)
    lines = F.array_join(_numbered(_hold_inner(code, language), cut=True), "\n")
    # JavaScript may end a statement with its line.
    joined = F.regexp_replace(lines, r"([=,+*/&|?:<>.(\[-]\s*)\n", "$1 ")
    joined = F.regexp_replace(joined, rf"\n({_ON}\d+{_OFF}\s*[.?:&|+*/=,)\]<>-])", " $1")
    script = _swap(joined, "\n", _CUT)
    strict = _swap(lines, "\n", " ")
    # Python goes on to the next line inside brackets.
    python = F.array_join(
        F.transform(
            tx.tokens(F.array_join(_numbered(code, cut=False), "\n"), _BRACKETED),
            lambda t: F.when(t.rlike(r"^[(\[{]"), _swap(t, "\n", " ")).otherwise(t),
        ),
        "",
    )
    cut = F.split(
        F.when(language == "py", _swap(python, "\n", _CUT))
        .when(language.isin(*_SCRIPT), script)
        .otherwise(strict),
        _CUT,
    )
    return F.filter(cut, lambda p: p.rlike(rf"{_OFF}\s*[^\s{_ON}]"))


def piece_text(piece: Column) -> Column:
    bare = F.regexp_replace(piece, _MARK, "")
    held = piece.rlike(f"[{_HELD}]")
    return F.btrim(
        F.when(held, F.translate(bare, _HELD, _DELIMITERS)).otherwise(bare), F.lit(" \t\r\n"))


def piece_line(piece: Column) -> Column:
    """Line on which the statement's first character stands."""
    return F.regexp_extract(piece, rf"{_MARK}(?!\s*{_ON})", 1).cast("int")


def piece_last_line(piece: Column) -> Column:
    return F.regexp_extract(piece, rf"(?s).*{_MARK}", 1).cast("int")


_BLOCK = ("struct<open_seq:int,close_seq:int,line_start:int,line_end:int,header:string,is_function:boolean,"
          "parent:int,depth:int>")
_OPEN = "struct<seq:int,indent:int,line:int,header:string,is_function:boolean,nth:int>"
#: Events that one fold goes through.  Spark copies a fold's state at each step, so what a fold gathers has to stay small.
_CHUNK = 128
_END = 2147483647
#: Blocks of a file up to which each is asked about a statement, which is less work than halving.
_FEW = 24


def block_events(parts: Column, language: Column) -> Column:
    """Statements that open or close a block."""
    python = language == "py"

    def event(p: Column, i: Column) -> Column:
        last = F.right(p, F.lit(1))
        opens = F.when(python, F.rtrim(piece_text(p)).endswith(":")).otherwise(last == "{")
        return F.struct(
            i.alias("seq"),
            F.when(python, F.lit("p")).otherwise(last).alias("kind"),
            F.when(python, F.length(F.regexp_extract(p, rf"{_MARK}([ \t]*)(?!\s*{_ON})", 2)))
            .otherwise(0).alias("indent"),
            opens.alias("opens"),
            F.when(opens, piece_text(p)).alias("header"),
            piece_line(p).alias("line"),
            piece_last_line(p).alias("last_line"),
        )

    wanted = F.filter(
        F.transform(parts, lambda p, i: F.struct(i.alias("i"), p.alias("p"))),
        lambda s: python | F.right(s.p, F.lit(1)).isin("{", "}"),
    )
    # Lambdas do not share subexpressions, so the header is put together once, here.
    found = F.transform(wanted, lambda s: event(s.p, s.i))
    return F.transform(
        found,
        lambda e: F.struct(
            *[e[f].alias(f) for f in ("seq", "kind", "indent", "opens", "header", "line", "last_line")],
            F.when(e["opens"], is_function(e["header"], language)).alias("is_function"),
        ),
    )


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once; lambdas do not share subexpressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blocks(events: Column, parts: Column, language: Column) -> Column:
    """Blocks of a file in the order they open: opening and closing statement, lines, header, parent and depth.

    ``parent`` is the place of the surrounding block in this array, or -1.  A closing
    brace ends the newest open block; in Python a statement ends every block that is indented as deep or deeper.

    Brackets are matched in chunks of events.  What a chunk does to the blocks that are open in front of it is
    a summary (closers it can't match itself, or its least indent, and openers it leaves); summaries compose in order
    and give every chunk its open blocks, with which it is folded on its own.  Time grows with the number of events.
    """
    python = language == "py"
    stack_kind, no_blocks = f"array<{_OPEN}>", F.array().cast(f"array<{_BLOCK}>")

    def kept(stack: Column, e: Column) -> Column:
        depth = F.size(stack)
        return (F.when(e.kind == "}", F.greatest(depth - 1, F.lit(0)))
                .when(e.kind == "p", F.size(F.filter(stack, lambda o: o.indent < e.indent))).otherwise(depth))

    def after(stack: Column, e: Column, nth: Column) -> Column:
        keep = kept(stack, e)
        opened = F.struct(e.seq.alias("seq"), e.indent.alias("indent"), e.line.alias("line"), e.header.alias("header"),
                          e.is_function.alias("is_function"), nth.alias("nth"))
        return (F.when(e.opens, F.concat(F.slice(stack, F.lit(1), keep), F.array(opened)))
                .when(keep < F.size(stack), F.slice(stack, F.lit(1), keep)).otherwise(stack))

    def more(acc: Column, e: Column) -> Column:
        return F.when(e.opens, acc.opened + 1).otherwise(acc.opened)

    def summary(chunk: Column) -> Column:
        start = F.struct(F.lit(0).alias("pops"), F.lit(_END).alias("low"), F.array().cast(stack_kind).alias("stack"), F.lit(0).alias("opened"))
        return F.aggregate(chunk, start, lambda acc, e: F.struct(
            F.when((e.kind == "}") & (F.size(acc.stack) == 0), acc.pops + 1).otherwise(acc.pops).alias("pops"),
            F.least(acc.low, e.indent).alias("low"), after(acc.stack, e, acc.opened).alias("stack"), more(acc, e).alias("opened")))

    def close(stack: Column, keep: Column, seq: Column, line: Column) -> Column:
        def block(o: Column, i: Column) -> Column:
            return F.struct(
                o.seq.alias("open_seq"), seq.alias("close_seq"), o.line.alias("line_start"), line.alias("line_end"), o.header.alias("header"),
                o.is_function.alias("is_function"), F.coalesce(F.get(stack, keep + i - 1)["nth"], F.lit(-1)).alias("parent"),
                (keep + i + 1).alias("depth"))
        return F.transform(F.slice(stack, keep + 1, F.size(stack)), block)

    def step(acc: Column, e: Column) -> Column:
        keep = kept(acc.stack, e)
        shut = close(acc.stack, keep, F.when(python, acc.seq).otherwise(e.seq), F.when(python, acc.line).otherwise(e.last_line))
        return F.struct(
            after(acc.stack, e, acc.opened).alias("stack"),
            F.when(keep < F.size(acc.stack), F.concat(acc.out, shut)).otherwise(acc.out).alias("out"),
            more(acc, e).alias("opened"), e.seq.alias("seq"), e.last_line.alias("line"))

    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(events) - 1, F.lit(0)), F.lit(_CHUNK)), lambda k: F.slice(events, k + 1, _CHUNK))
    count = F.size(chunks)

    def following(acc: Column, s: Column) -> Column:
        keep = F.when(python, F.size(F.filter(acc.stack, lambda o: o.indent < s.low))).otherwise(F.greatest(F.size(acc.stack) - s.pops, F.lit(0)))
        left = F.transform(s.stack, lambda o: F.struct(*[o[f].alias(f) for f in ("seq", "indent", "line", "header", "is_function")],
                                                       (o.nth + acc.opened).alias("nth")))
        stack, opened = F.concat(F.slice(acc.stack, F.lit(1), keep), left), acc.opened + s.opened
        here = F.struct(stack.alias("stack"), opened.alias("opened"))
        return F.struct(stack.alias("stack"), opened.alias("opened"), F.concat(acc.out, F.array(here)).alias("out"))

    first = F.struct(F.array().cast(stack_kind).alias("stack"), F.lit(0).alias("opened"))
    begin = F.struct(first["stack"].alias("stack"), first["opened"].alias("opened"), F.array(first).alias("out"))
    summaries = F.transform(F.slice(chunks, F.lit(1), count - 1), summary)  # that of the last chunk is not asked for
    incoming = F.aggregate(summaries, begin, following, lambda acc: acc.out)

    def ended(acc: Column) -> Column:
        last = F.get(parts, F.size(parts) - 1)
        rest = close(acc.stack, F.lit(0), F.when(python, acc.seq).otherwise(F.size(parts) - 1),
                     F.when(python, acc.line).otherwise(piece_last_line(last)))
        return F.when(F.size(acc.stack) > 0, F.concat(acc.out, rest)).otherwise(acc.out)

    def whole() -> Column:
        start = F.struct(F.array().cast(stack_kind).alias("stack"), no_blocks.alias("out"), F.lit(0).alias("opened"),
                         F.lit(0).alias("seq"), F.lit(0).alias("line"))
        return F.aggregate(events, start, step, ended)

    def folded(s: Column, i: Column) -> Column:
        before = F.get(events, i * _CHUNK - 1)
        start = F.struct(s.stack.alias("stack"), no_blocks.alias("out"), s.opened.alias("opened"),
                         F.coalesce(before["seq"], F.lit(0)).alias("seq"), F.coalesce(before["last_line"], F.lit(0)).alias("line"))
        def finish(acc: Column) -> Column:
            return F.when((i + 1) * _CHUNK >= F.size(events), ended(acc)).otherwise(acc.out)
        return F.aggregate(F.slice(events, i * _CHUNK + 1, F.lit(_CHUNK)), start, step, finish)

    # Most files have one chunk: no summaries, no slices.
    return F.array_sort(F.when(F.size(events) <= _CHUNK, whole()).otherwise(F.flatten(F.transform(incoming, folded))))


def with_blocks(files: DataFrame, *keep: str) -> DataFrame:
    """Files with their statements (``parts``) and ``blocks``, still one row per file."""
    content, language = F.col("content"), F.col("language")
    return (
        files.select("project", "path", "language", *keep, pieces(content, language).alias("parts"))
        .withColumn("events", block_events(F.col("parts"), language))
        .withColumn("blocks", blocks(F.col("events"), F.col("parts"), language)).drop("events")
    )


def exploded_parts(
    rows: DataFrame, *keep: str, wanted: Callable[[Column], Column] | None = None, scoped: bool = True
) -> DataFrame:
    """One row per raw statement (``part``) with its ``text``.

    ``wanted`` is a cheap test of a part; the others are dropped before their
    text is put together.  With ``scoped``, each row has the blocks it lies in (``inside``) and the last line of the block it
    opens (``own_end``), looked up inside the file's row: the blocks of the file never go along.
    """
    parts = F.transform("parts", lambda p, i: F.struct(i.alias("seq"), p.alias("part")))
    if wanted is not None:
        parts = F.filter(parts, lambda s: wanted(s["part"]))
    if scoped:
        blocks_col = F.col("blocks")
        parts = F.transform(parts, lambda s: F.struct(
            s["seq"].alias("seq"), s["part"].alias("part"), enclosing(blocks_col, s["seq"]).alias("inside"),
            own_end(blocks_col, s["seq"]).alias("own_end")))
    return (
        rows.select(*keep, F.explode_outer(parts).alias("s"))
        .where(F.col("s").isNotNull())
        .select(*keep, "s.*")
        .withColumn("text", piece_text(F.col("part")))
    )


def inlined(rows: DataFrame, structs: Column | str, *keep: str) -> DataFrame:
    """One row per struct of an array, its fields as columns.

    The outer form and a test behind it spare the optimizer's ``size(structs) > 0`` filter, which would be pushed
    below the projections and compute the whole array once more for every place that it is named in.
    """
    return rows.select(*keep, F.explode_outer(structs).alias("__row")).where(F.col("__row").isNotNull()).select(
        *keep, "__row.*")


def statements(
    files: DataFrame, wanted: Callable[[Column], Column] | None = None, scoped: bool = False
) -> DataFrame:
    """One row per statement, with its place among the blocks if asked."""
    if scoped:
        rows, scope = with_blocks(files), ("inside", "own_end")
    else:
        content, language = F.col("content"), F.col("language")
        rows, scope = files.select("project", "path", "language", pieces(content, language).alias("parts")), ()
    return exploded_parts(rows, "project", "path", "language", wanted=wanted, scoped=scoped).select(
        "project", "path", "language", "seq", piece_line(F.col("part")).alias("line"),
        piece_last_line(F.col("part")).alias("last_line"), "text", *scope)


def is_function(header: Column, language: Column) -> Column:
    """Does this block header define a function?"""
    control = r"^\}?\s*(if|for|while|switch|catch|else|do|try|return|unchecked|assembly)\b"
    script = header.rlike(r"\bfunction\b|=>\s*\{$") | (
        header.rlike(r"^(?:(?:async|static|get|set|public|private|protected)\s+)*[\w$]+\s*"
                     r"\([^()]*\)[^()=]*\{$") & ~header.rlike(control)
    )
    return (
        F.when(language == "sol",
               header.rlike(r"^(function|constructor|fallback|receive|modifier)\b"))
        .when(language == "py", header.rlike(r"^(async\s+)?def\b"))
        .when(language.isin("mq4", "mq5"),
              header.rlike(r"^[\w*&:]+(\s+[\w*&:]+)+\s*\([^()]*\)\s*\{$") & ~header.rlike(control))
        .otherwise(script)
    )


def _opened_before(blocks_col: Column, seq: Column) -> Column:
    """Number of blocks that open before a statement, by halving."""
    n = F.size(blocks_col)

    def halve(acc: Column, _: Column) -> Column:
        def move(mid: Column) -> Column:
            low = F.get(blocks_col, mid)["open_seq"] < seq
            return (F.when(acc.lo >= acc.hi, acc)
                    .when(low, F.struct((mid + 1).alias("lo"), acc.hi.alias("hi")))
                    .otherwise(F.struct(acc.lo.alias("lo"), mid.alias("hi"))))
        return _let(F.shiftright(acc.lo + acc.hi, 1), move)
    rounds = F.sequence(F.lit(1), F.length(F.bin(n.cast("long"))).cast("int"))
    return F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve, lambda acc: acc.lo)


def enclosing(blocks_col: Column, seq: Column) -> Column:
    """Blocks a statement lies in, outermost first (its own header is outside).

    In a file of few blocks each one is asked; else from the last block that opens before the statement upward, so work follows the depth.
    """
    def climb(k: Column) -> Column:
        def up(acc: Column, _: Column) -> Column:
            return _let(F.get(blocks_col, acc.at), lambda b: F.struct(
                F.coalesce(b["parent"], F.lit(-1)).alias("at"),
                F.when(b["close_seq"] >= seq, F.concat(F.array(b), acc.out)).otherwise(acc.out).alias("out")))
        depth = F.coalesce(F.get(blocks_col, k)["depth"], F.lit(0))
        start = F.struct(k.alias("at"), F.array().cast(f"array<{_BLOCK}>").alias("out"))
        levels = F.filter(F.sequence(F.lit(0), depth), lambda d: d > 0)
        return F.aggregate(levels, start, up, lambda acc: acc.out)
    asked = F.filter(blocks_col, lambda b: (b["open_seq"] < seq) & (b["close_seq"] >= seq))
    return F.when(F.size(blocks_col) <= _FEW, asked).otherwise(_let(_opened_before(blocks_col, seq) - 1, climb))


def own_end(blocks_col: Column, seq: Column) -> Column:
    """Last line of the block that a statement opens; null if it opens none."""
    asked = F.get(F.filter(blocks_col, lambda b: b["open_seq"] == seq), F.lit(0))["line_end"]
    halved = _let(F.get(blocks_col, _opened_before(blocks_col, seq)), lambda b: F.when(b["open_seq"] == seq, b["line_end"]))
    return F.when(F.size(blocks_col) <= _FEW, asked).otherwise(halved)


def with_scope(rows: DataFrame) -> DataFrame:
    """Add ``fn`` (innermost function) and ``block_end`` to rows with ``inside``."""
    return (
        rows.withColumn("fn", F.array_max(F.filter("inside", lambda b: b.is_function)))
        .withColumn(
            "block_end",
            F.coalesce(F.array_max("inside").getField("close_seq"), F.lit(2147483647)),
        )
    )


_DECLARATION = r"^(function|constructor|fallback|receive|modifier)\b"
_NOT_MODIFIERS = (
    "public", "external", "internal", "private", "pure", "view", "payable", "nonpayable",
    "virtual", "override",
)


def _parameters(inner: Column) -> Column:
    parts = F.transform(F.split(inner, ","), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.filter(parts, lambda p: p != "")


class Statement(NamedTuple):
    """What a statement fact can look at."""

    text: Column
    line: Column
    last_line: Column
    seq: Column
    inside: Column
    own_end: Column


StatementFact = Callable[[Statement], tuple[Column, dict[str, Column]]]


def statement_facts(
    files: DataFrame, fact: StatementFact, words: str | None = None, scoped: bool = False
) -> DataFrame:
    """Rows of one fact over the statement table (``seq`` gives the order).

    ``words`` is a pattern every such statement fits somewhere: files without it
    are not parsed at all.  ``scoped`` facts look at the blocks around or below a statement.

    Condition and columns sit in a generator: a plain filter would be pushed
    below the projection and compute the statement's text again per pattern.
    """
    none = F.lit(None)
    condition, columns = fact(Statement(*[
        F.col(c) if scoped or c not in ("inside", "own_end") else none for c in Statement._fields]))
    row = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    wanted = None
    if words is not None:
        files, wanted = files.where(F.col("content").rlike(words)), lambda part: part.rlike(words)
    return (
        statements(files, wanted, scoped)
        .select("project", "path", "seq", F.explode_outer(F.when(condition, row)).alias("row"))
        .where(F.col("row").isNotNull())
        .select("project", "path", "seq", "row.*")
    )


def nested_statements(parts: Column) -> Column:
    """Statements of a file as an array, in source order."""
    return F.transform(
        parts,
        lambda p, i: F.struct(
            piece_text(p).alias("text"), piece_line(p).alias("line"),
            piece_last_line(p).alias("last_line"), i.alias("seq"),
        ),
    )


def nested_statement_facts(rows: Column, blocks_col: Column, fact: StatementFact) -> Column:
    """The same rows as an array inside the file's row."""
    def one(s: Column) -> Column:
        condition, columns = fact(Statement(
            s["text"], s["line"], s["last_line"], s["seq"], enclosing(blocks_col, s["seq"]), own_end(blocks_col, s["seq"])))
        return F.when(condition, F.struct(*[c.alias(n) for n, c in columns.items()]))

    return F.filter(F.transform(rows, one), lambda r: r.isNotNull())


def function_fact(s: Statement) -> tuple[Column, dict[str, Column]]:
    """Functions, constructors, fallbacks and modifiers of a Solidity file."""
    kind = F.regexp_extract(s.text, _DECLARATION, 1)
    attributes = F.regexp_replace(
        F.regexp_extract(s.text, r"^\w+\s*[\w$]*\s*(?:\([^()]*\))?([^{;]*)", 1),
        r"\b(?:returns|override)\s*\([^()]*\)", " ",
    )
    found = F.regexp_extract(attributes, r"\b(public|external|internal|private)\b", 1)
    visibility = F.when(found == "", "internal").otherwise(found)
    found = F.regexp_extract(attributes, r"\b(pure|view|payable|nonpayable)\b", 1)
    mutability = F.when(found == "", "nonpayable").otherwise(found)
    return s.text.rlike(_DECLARATION), {
        "name": F.when(kind.isin("constructor", "fallback", "receive"), kind).otherwise(
            F.regexp_extract(s.text, r"^\w+\s+([\w$]+)", 1)),
        "visibility": visibility,
        "mutability": mutability,
        "modifiers": F.filter(
            F.regexp_extract_all(attributes, F.lit(r"([\w$.]+(?:\s*\([^()]*\))?)"), F.lit(1)),
            lambda m: ~m.isin(*_NOT_MODIFIERS),
        ),
        "parameters": _parameters(
            F.regexp_extract(s.text, r"^\w+\s*[\w$]*\s*\(([^()]*)\)", 1)),
        "is_payable": mutability == "payable",
        "is_external": visibility.isin("external", "public"),
        "line_start": s.line,
        "line_end": F.coalesce(s.own_end, s.last_line),
        "node_type": F.when(kind == "function", "function_definition")
        .when(kind == "constructor", "constructor_definition")
        .when(kind == "modifier", "modifier_definition")
        .otherwise("fallback_receive_definition"),
    }


_VARIABLE = (
    r"(?s)^(mapping\s*\(.*\)|[\w.]+(?:\s*\[[^\]]*\])*)\s+"
    r"((?:(?:public|private|internal|constant|immutable|override|transient)\s+)*)"
    r"([\w$]+)\s*(?:=[^=>].*)?;$"
)
_NOT_VARIABLE = r"^(return|emit|delete|using|import|event|error|pragma|type|enum|struct)\b"


def variable_fact(s: Statement) -> tuple[Column, dict[str, Column]]:
    """Declarations directly inside a contract, library or interface."""
    attributes = F.regexp_extract(s.text, _VARIABLE, 2)
    found = F.regexp_extract(attributes, r"\b(public|private|internal)\b", 1)
    condition = (
        s.text.rlike(_VARIABLE) & ~s.text.rlike(_NOT_VARIABLE) & (F.size(s.inside) == 1)
        & F.get(s.inside, F.lit(0)).getField("header").rlike(
            r"^(abstract\s+)?(contract|library|interface)\b")
    )
    return condition, {
        "name": F.regexp_extract(s.text, _VARIABLE, 3),
        "type_name": F.regexp_extract(s.text, _VARIABLE, 1),
        "visibility": F.when(found == "", "internal").otherwise(found),
        "is_constant": attributes.rlike(r"\bconstant\b"),
        "is_immutable": attributes.rlike(r"\bimmutable\b"),
        "line": s.line,
    }


def event_fact(s: Statement) -> tuple[Column, dict[str, Column]]:
    """Event definitions with their parameters."""
    pattern = r"^event\s+([\w$]+)\s*\(([^)]*)\)"
    return s.text.rlike(pattern), {
        "name": F.regexp_extract(s.text, pattern, 1),
        "parameters": _parameters(F.regexp_extract(s.text, pattern, 2)),
        "line": s.line,
    }


def _solidity(files: DataFrame) -> DataFrame:
    return files.where(F.col("language") == "sol")


def functions(files: DataFrame) -> DataFrame:
    return statement_facts(
        _solidity(files), function_fact, "function|constructor|fallback|receive|modifier", scoped=True)


def state_variables(files: DataFrame) -> DataFrame:
    return statement_facts(_solidity(files), variable_fact, "contract|library|interface|;", scoped=True).drop("seq")


def events(files: DataFrame) -> DataFrame:
    return statement_facts(_solidity(files), event_fact, "event").drop("seq")


def modifiers(functions_df: DataFrame) -> DataFrame:
    """Modifier definitions out of the function table."""
    return functions_df.where(
        (F.col("node_type") == "modifier_definition") & (F.col("name") != "")
    ).select("project", "path", "name", "parameters", "line_start", "line_end")
