"""Generated, minified and vendored source files, and data saved as code.

Three kinds of evidence, strongest first:

* marks: directories of third-party code, names of lock files, and comments at
  a file's start or end that name another project or a generating tool;
* containment: an inverted index of line hashes gives, for every file, all files
  that may hold enough of its rare lines; the share of the file's lines held in
  each is then counted exactly, so edited copies are found wherever they lie;
* composition: what the lexical tokens of the remaining files consist of -
  literals only, dense lines, names numbered by a machine in lines of few shapes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.skew import fragment_replicate_join
from tessera.sources.tables import cut_lineage

# Directories that hold other projects' code.
VENDOR_DIRS = {"node_modules", "bower_components", "vendor", "vendors", "vendored", "_vendor", "third_party", "thirdparty", "third-party", "extern", "externals", "site-packages", "dist-packages", ".venv", "venv"}
# Names of lock files.
LOCK_FILES = {"package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "pipfile.lock", "cargo.lock", "composer.lock", "gemfile.lock", "uv.lock", "pdm.lock", "go.sum", "packages.lock.json", "flake.lock", "mix.lock", "podfile.lock"}
_GENERATED_NAME = re.compile(r"(?:_pb2(?:_grpc)?\.pyi?|\.pb\.go|\.g\.dart|\.designer\.cs|\.gen\.\w+|\.generated\.\w+)$", re.I)
_MINIFIED_NAME = re.compile(r"\.(?:min|bundle|chunk)\.(?:m?js|css)$", re.I)
_DATA_EXTENSIONS = {"json", "toml", "xml", "yaml", "yml", "ini", "cfg", "conf", "env", "properties", "csv", "md", "txt", "rst"}
_COMMENT = re.compile(r"^\s*(?:#|//|/\*|\*|<!--|--|;|%)")
_PREAMBLE = re.compile(r"^#!|^\s*<(?:\?(?:xml|php)\b|!DOCTYPE\b)[^>]*>?\s*$", re.I)
_GENERATED = re.compile(
    r"(?i)@generated\b|\bauto(?:matically)?[- ]?generated\b|\bautogenerated\b|\bmachine[- ](?:written|generated|made)\b"
    r"|\bgenerated\s+(?:by|from|with|using|on|at)\b|\bdo not (?:edit|modify|change)\b.*\b(?:generated|by hand|manually)\b|\bautomatisch\s+(?:erzeugt|generiert|erstellt)\b"
    r"|g[ée]n[ée]r[ée]e?\s+automatiquement|generad[oa]\s+autom[áa]ticamente|generato\s+automaticamente|gerado\s+automaticamente|\bmanual changes will be (?:lost|overwritten)\b"
)
_SUBJECT = re.compile(r"(?i)\b(?:code|file|module|class|source|stubs?|bindings?)\b")
_MADE = re.compile(r"(?i)\b(?:generated|produced|emitted|created)\s+(?:automatically\s+)?(?:by|from|with|using)\b")
_NOT_GENERATED = re.compile(r"(?i)\bnot\s+(?:auto|machine|automatically)?[- ]?(?:generated|produced)|\bby hand, not\b|\bgenerated by hand\b|\bmarked\b|\bhow many\b")
_COPIED = re.compile(
    r"(?i)\b(?:bundled|vendored|verbatim|local|patched|modified)\s+copy\s+of\s+(?P<a>[\w.-]+)|\b(?:taken|copied|vendored|imported|borrowed|adapted|lifted)\s+(?:unchanged\s+|verbatim\s+|as is\s+|over\s+)?from\s+(?P<b>[\w.-]+)\s+v?\d"
    r"|\b(?:taken|copied|vendored)\s+(?:unchanged|verbatim)\s+from\s+(?P<c>[\w.-]+)|\bthis file is (?:a )?part of (?P<d>[\w-]+)|\bcopyright\s+(?:\(c\)|©)?\s*[\d, -]+\s*(?:by\s+)?the\s+(?P<e>[\w-]+)\s+(?:authors|project|developers|contributors|team)\b"
    r"|\bkeep in sync with upstream\b|\bsend fixes (?:there|upstream)\b"
)
_RANDOM = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}|(?:\\x[0-9a-fA-F]{2}){8,}")
_DIGITS = re.compile(r"\d+")
_LOCK = re.compile(r"lock_?file|\"(?:packages|dependencies)\"|\[\[package\]\]", re.I)
_LOCK_WORDS = ("lockfile", "lock_file", '"packages"', '"dependencies"', "[[package]]")
_HASH_LINE = re.compile(r"\"?(?:integrity|checksum|hash|resolved|sha256|sha512)\"?\s*[:=]\s*\"?", re.I)
# Lexical tokens by family of languages; all that is no token of the others is a mark.
_QUOTED = r"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'"
_COMMENTS = {"hash": r"\#[^\n]*+", "slash": r"//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/", "dash": r"--[^\n]*+", "markup": r"<!--(?:[^-]|-(?!->))*+-->", "none": r"(?!)"}
_STRINGS = {"hash": r"\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*+\"\"\"|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*+\'\'\'|" + _QUOTED, "slash": r"`(?:[^`\\]|\\.)*+`|" + _QUOTED}
_LEXERS = {
    f: re.compile(rf"(?P<comment>{c})|(?P<string>{_STRINGS.get(f, _QUOTED)})|(?P<number>0[xX][0-9a-fA-F]+|\d+(?:\.\d*)?(?:[eE][-+]?\d+)?)|(?P<name>[^\W\d]\w*)|(?P<space>[^\S\n]+)|(?P<line>\n)|(?P<mark>.)", re.S)
    for f, c in _COMMENTS.items()
}
# Extensions of each family; others are read like the first.
_FAMILIES = {
    "hash": {"py", "pyi", "sh", "bash", "rb", "pl", "r", "yaml", "yml", "toml", "ini", "cfg", "conf", "env", "properties", "mk", "tf"},
    "slash": {"js", "mjs", "cjs", "jsx", "ts", "tsx", "java", "go", "c", "h", "cc", "cpp", "hpp", "cs", "css", "scss", "php", "rs", "swift", "kt", "scala", "dart", "proto"},
    "dash": {"sql", "lua", "hs", "elm"}, "markup": {"xml", "html", "htm", "svg", "vue", "md"}, "none": {"json", "csv", "txt"},
}
_FAMILY_OF = {e: f for f, es in _FAMILIES.items() for e in es}
# What a text must hold before lexical tokens can make it more than hand-written: starts of
# tokens that go over lines, beyond strings and comments that have their lines for themselves,
# seven numbers in a list, a random string's start, a serial name.
_OWN_LINES = {
    "hash": re.compile(r"^[ \t]*+(?:\"\"\"[^\"\\]*+\"\"\"|'''[^'\\]*+''')[ \t]*+([^\n]?)", re.M),
    "slash": re.compile(r"^[ \t]*+/\*(?:[^*]|\*(?!/))*+\*/[ \t]*+([^\n]?)", re.M),
    "markup": re.compile(r"^[ \t]*+<!--(?:[^-]|-(?!->))*+-->[ \t]*+([^\n]?)", re.M),
}
_OVER_LINES = {"hash": ('"""', "'''"), "slash": ("`", "/*"), "markup": ("<!--",)}
_CLOSE = {"slash": "*/", "markup": "-->"}
_NUMBERS = re.compile(r"\d(?<!\w\d)\w*+(?:\.\w*+)?[\s,+-]++(?:\d\w*+(?:\.\w*+)?[\s,+-]++){5}\d")
_RANDOM_START = re.compile(r"[\"'`](?:[A-Za-z0-9+/_-]{32,}+|\\x)")
_SERIAL = re.compile(r"\d\d\d(?<=[^\W\d]\d\d\d)")


def _block(lines: list[str]) -> list[str]:
    """Comment lines before the first line that is none; blocks are followed."""
    out, close = [], None
    for line in lines:
        if close:
            out.append(line)
            close = None if close in line else close
        elif line.strip() and not _PREAMBLE.match(line):
            if not _COMMENT.match(line):
                break
            out.append(line)
            for start, end in (("/*", "*/"), ("<!--", "-->")):
                if line.lstrip().startswith(start) and end not in line.lstrip()[len(start) :]:
                    close = end
    return out


def _trailer(lines: list[str]) -> list[str]:
    """Comment lines after the last line that is none; blocks are followed."""
    out, start = [], None
    for line in reversed(lines):
        bare = line.strip()
        if start is None:
            ends = next((s for s, e in (("/*", "*/"), ("<!--", "-->")) if bare.endswith(e)), None)
            if bare and not ends and not _COMMENT.match(line):
                break
            if ends and ends in bare and not bare.startswith(ends):
                break  # a comment behind code
            start = ends if ends and not bare.startswith(ends) else None
            held: list[str] = []
        if start is None:
            out += [line] if bare else []
            continue
        held.append(line)
        if start in bare:
            if not bare.startswith(start):
                break
            out += held
            start = None
    return out[::-1]


def _says_generated(line: str) -> bool:
    if _NOT_GENERATED.search(line):
        return False
    if _GENERATED.search(line):
        return True
    # The subject stands before the verb in one clause.
    return any((m := _SUBJECT.search(c)) is not None and _MADE.search(c, m.end()) is not None for c in re.split("[.;]", line)) if _MADE.search(line) else False


def header_origin(path: str, repository: str, text: str) -> str | None:
    """``generated`` or ``vendored`` by the comments at the file's start or end, else None."""
    lines = text.removeprefix("\ufeff").split("\n")
    head = _block(lines)
    tail = _trailer(lines)
    own = {w.lower() for w in re.split(r"[/\\]", f"{repository}/{path}") if w}
    for block in (head, tail):
        if any(_says_generated(h) for h in block):
            return "generated"
    for block in (head, tail):
        for m in _COPIED.finditer("\n".join(block)):
            project = next((g for g in m.groups() if g), "").lower().rstrip(".")
            if not project or project not in own:
                return "vendored"
    return None


def path_origin(path: str) -> str | None:
    """``vendored`` or ``lock`` by the path, else None."""
    parts = [p.lower() for p in path.replace("\\", "/").split("/") if p]
    if any(p in VENDOR_DIRS for p in parts[:-1]):
        return "vendored"
    return "lock" if parts and parts[-1] in LOCK_FILES else None


class Composition:
    """What the tokens of a text consist of."""

    def __init__(self, text: str, family: str):
        self.literal = self.dense = self.numbered = 0
        shapes: Counter[str] = Counter()
        run = run_size = held = 0  # numbers in a list, their characters, and those since the last
        size = strings = marks = spaces = 0  # of the line
        serial, shape = False, []
        self.lines = 0
        for m in _LEXERS[family].finditer(text + "\n"):
            kind, token = m.lastgroup, m.group()
            n = len(token)
            if kind == "number":
                run, run_size, held = run + 1, run_size + held + n, 0
            elif run and (kind in ("space", "line") or token in ",+-"):
                held += n
            else:
                if run > 6:
                    self.literal += run_size
                run = run_size = held = 0
            if kind == "line":
                if shape:
                    self.lines += 1
                    shapes["".join(shape).strip()] += 1
                    self.numbered += serial
                    code = size - strings
                    if size >= 200 and code >= 150 and marks >= 0.15 * code and spaces <= 0.12 * code:
                        self.dense += size
                size = strings = marks = spaces = 0
                serial, shape = False, []
                continue
            size += n
            if kind == "space":
                if shape:
                    spaces += n
                    shape.append(" ")
            elif kind == "string":
                strings += n
                shape.append("S")
                if n > 33 and _RANDOM.fullmatch(token, 1, n - 1):
                    self.literal += n
            elif kind == "name":
                # Names that end in three digits come from a counter.
                if n > 3 and token[-3:].isdigit():
                    serial = True
                shape.append(_DIGITS.sub("0", token) if token[-1].isdigit() else token)
            else:
                marks += n if kind == "mark" else 0
                shape.append({"mark": token, "number": "0", "comment": "C"}[kind])
        self.literal += run_size if run > 6 else 0
        self.covered = sum(c for _, c in shapes.most_common(6))


def _names_lock(text: str) -> bool:
    if text.isascii():
        low = text.lower()
        return any(w in low for w in _LOCK_WORDS)
    return _LOCK.search(text) is not None


def _hand_written(text: str, lines: list[str], family: str, dense_share: float, least_lines: int, numbered_share: float) -> bool:
    """Whether bounds on what ``Composition`` would count rule out every origin.

    The bounds hold where lines of tokens are lines of text and all digits are
    ASCII; strings and comments of whole lines add nothing.  False says nothing.
    """
    size, n_lines, starts = len(text), len(lines), _OVER_LINES.get(family, ())
    if any(x in text for x in starts):
        if text.rfind(starts[-1]) > text.rfind(_CLOSE.get(family, starts[-1])):
            return False  # and a search for the end from every start would take long
        # Where code follows on the line, the start is put back.
        text = _OWN_LINES[family].sub(lambda m: m[1] and starts[-1], text)
        lines = [x for x in text.split("\n") if x and not x.isspace()]
        if any(x in text for x in starts):
            return False
    if "\\\n" in text or not (text.isascii() or all(c < "\x80" or not c.isdigit() for c in set(text))):
        return False
    if sum(n for x in lines if (n := len(x)) >= 200) >= dense_share * size:
        return False
    if n_lines >= least_lines and len(_SERIAL.findall(text)) >= numbered_share * len(lines):
        return False
    drawn = _RANDOM_START.findall(text)
    # A random string has its closing quote and at most two signs of padding besides.
    return not any(x[1] == "\\" for x in drawn) and sum(len(x) + 3 for x in drawn) < 0.6 * size and _NUMBERS.search(text) is None


def composition_origin(path: str, text: str) -> str | None:
    """``data``, ``minified``, ``generated`` or ``lock`` by what a text consists of."""
    name = path.replace("\\", "/").rsplit("/", 1)[-1].lower()
    extension = name.rsplit(".", 1)[-1] if "." in name else ""
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    if not lines:
        return None
    if _names_lock(text) and sum(bool(_HASH_LINE.search(x)) for x in lines) >= max(3, 0.15 * len(lines)):
        return "lock"
    if extension in _DATA_EXTENSIONS or name.startswith(".env"):
        return None
    family, size, short = _FAMILY_OF.get(extension, "hash"), len(text), bool(_MINIFIED_NAME.search(name))
    low = bool(_GENERATED_NAME.search(name)) or any(p in ("_gen", "generated", "__generated__") for p in path.replace("\\", "/").lower().split("/")[:-1])
    least_lines, numbered_share, covered_share = (4, 0.2, 0.5) if low else (8, 0.3, 0.7)
    if _hand_written(text, lines, family, 0.2 if short else 0.5, least_lines, numbered_share):
        return None
    made = Composition(text, family)
    if made.literal >= 0.6 * size:
        return "data"
    if made.dense >= 0.5 * size or (short and made.dense >= 0.2 * size):
        return "minified"
    if made.lines >= least_lines and made.numbered >= numbered_share * made.lines and made.covered >= covered_share * made.lines:
        return "generated"
    return None


MARKED = T.StructType([T.StructField("path_origin", T.StringType()), T.StructField("header_origin", T.StringType()), T.StructField("composition", T.StringType())])


@F.pandas_udf(MARKED)
def _marks(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for paths, repositories, texts in batches:
        rows = []
        for p, r, t in zip(paths, repositories, texts):
            p, r, t = (x if isinstance(x, str) else "" for x in (p, r, t))
            rows.append((path_origin(p), header_origin(p, r, t), composition_origin(p, t)))
        yield pd.DataFrame(rows, columns=MARKED.names)


#: Shared lines, and candidates, may be broadcast below this many bytes.
BROADCAST_BYTES = 32 << 20
_ROW_BYTES = 128


def line_hashes(files: DataFrame, *, least_chars: int = 12) -> DataFrame:
    """``file, repo, hashes``: the distinct hashes of each file's lines.

    Lines are compared without surrounding blanks and with single blanks inside;
    shorter ones say nothing.  A file delivered twice counts once.  Everything
    runs in the JVM, and only hashes are shuffled.
    """
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    hashes = F.array_distinct(F.transform(F.filter(lines, lambda x: F.length(x) >= least_chars), lambda x: F.xxhash64(x)))
    rows = files.where(F.col("text").isNotNull() & F.col("file").isNotNull() & F.col("repo").isNotNull())
    one = rows.select("file", F.struct("repo", hashes.alias("hashes")).alias("r")).groupBy("file").agg(F.max("r").alias("r"))
    return one.select("file", "r.repo", "r.hashes")


def _spread_join(large: DataFrame, small: DataFrame, key: str, width: Column | None = None) -> DataFrame:
    """Join on ``key``: broadcast by the counted size of ``small``, else fragmented.

    ``width`` is what a row of ``small`` takes beyond _ROW_BYTES."""
    size = small.agg(F.sum(F.lit(_ROW_BYTES) + (F.lit(0) if width is None else width))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return large.join(F.broadcast(small), key)
    return fragment_replicate_join(large, small, key)


def copies_elsewhere(files: DataFrame, *, least_share: float = 0.6, least_lines: int = 5, rare_share: float = 0.01, rare_files: int = 100) -> DataFrame:
    """``file, origin, partner, shared, n_lines``: files held by files of another repository.

    ``files`` is the result of ``line_hashes``, with the files' marks in
    ``origin`` where there are any; marked files are holders only.  A line is
    rare if at most ``rare_share`` of all files have it, or ``rare_files`` in a
    small corpus; other lines are no evidence and do not count.  Files
    of equal lines are one class.  A holder of the share asked for has at least
    one of the rarest lines of a class, as many as it may lack and one more;
    all holders of those are candidates, and each is counted exactly.  Of all
    holders of a file, the first and the last by repository are given for each
    ``origin``, so that one in another repository is never hidden.
    """
    if "origin" not in files.columns:
        files = files.withColumn("origin", F.lit(None).cast("string"))
    key = F.md5(F.array_join(F.transform(F.sort_array("hashes"), lambda x: x.cast("string")), ","))
    members = files.where(F.size("hashes") > 0).withColumn("same", key)
    classes = members.groupBy("same").agg(F.min("file").alias("class"), F.count(F.lit(1)).alias("copies"), F.count_if(F.col("origin").isNull()).alias("asked"), F.first("hashes").alias("hashes"))
    classes = cut_lineage(classes)
    members = members.drop("hashes").join(classes.select("same", "class"), "same").drop("same")
    limit = max(rare_files, int(files.count() * rare_share))
    postings = classes.select("class", "copies", F.explode("hashes").alias("h"))
    shared = postings.groupBy("h").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("holders"))
    shared = cut_lineage(shared.where((F.col("holders") > 1) | (F.col("n") > limit)))
    hits = _spread_join(postings.select("class", "h"), shared, "h").groupBy("class")
    # Lines of one class alone are the rarest of all and lead to no other class.
    lines = hits.agg(F.count_if(F.col("n") > limit).alias("common"), F.array_sort(F.collect_list(F.when(F.col("n") <= limit, F.struct("holders", "h")))).alias("lines"))
    n_lines = F.size("hashes") - F.coalesce("common", F.lit(0))
    held = classes.join(lines, "class", "left").select("class", "asked", n_lines.alias("n_lines"), F.coalesce(F.col("lines.h"), F.array().cast("array<bigint>")).alias("lines"))
    least = F.greatest(F.lit(least_lines), F.ceil(F.round(F.col("n_lines") * least_share, 6))).cast("int")
    held = cut_lineage(held.withColumn("least", least))
    asked = held.where((F.col("asked") > 0) & (F.col("n_lines") >= F.col("least")))
    probes = asked.where(F.size("lines") >= F.col("least")).select("class", "least", F.explode(F.slice("lines", F.lit(1), F.size("lines") - F.col("least") + 1)).alias("h"))
    holders = held.where(F.size("lines") >= least_lines).select(F.col("class").alias("holder"), F.size("lines").alias("size"), F.explode("lines").alias("h"))
    pairs = _spread_join(holders, probes, "h").where((F.col("holder") != F.col("class")) & (F.col("size") >= F.col("least"))).select("class", "holder").distinct()
    pairs = cut_lineage(pairs)
    ours, theirs = held.select("class", "least", "lines"), held.select(F.col("class").alias("holder"), F.col("lines").alias("others"))
    # One file may be the holder of a third of all others.
    theirs = cut_lineage(theirs.join(pairs.select("holder").distinct(), "holder", "left_semi"))
    exact = _spread_join(cut_lineage(pairs.join(ours, "class")), theirs, "holder", 8 * F.size("others")).select("class", "holder", "least", F.size(F.array_intersect("lines", "others")).alias("shared"))
    exact = exact.where(F.col("shared") >= F.col("least")).drop("least").unionByName(asked.select("class", F.col("class").alias("holder"), F.col("n_lines").alias("shared")))
    at = F.struct("repo", "file")
    ends = members.groupBy(F.col("class").alias("holder"), "origin").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    end = lambda c: F.struct(F.col(f"{c}.repo"), F.col(f"{c}.file"), F.col("shared"))
    best = exact.join(ends, "holder").groupBy("class", "origin").agg(F.min(end("first")).alias("first"), F.max(end("last")).alias("last"))
    files_of = members.where(F.col("origin").isNull()).select("file", "repo", "class").join(asked.select("class", "n_lines"), "class")
    found = files_of.join(best, "class").select("file", "repo", "origin", "n_lines", F.explode(F.array_distinct(F.array("first", "last"))).alias("p"))
    return found.where(F.col("p.repo") != F.col("repo")).select("file", "origin", F.col("p.file").alias("partner"), F.col("p.shared").alias("shared"), "n_lines")


def file_origins(files: DataFrame, *, path: str = "rel_path", text: str = "text", file_id: str = "file_id", repository_id: str = "repository_id", repository: str = "repository") -> DataFrame:
    """``file_id, origin, evidence`` of the files that nobody of the project wrote.

    ``origin`` is vendored, lock, generated, minified or data; ``evidence`` is
    path, header, composition or containment.  Of two repositories that share a
    file without any mark, the one with the smaller id is taken for its author,
    unless the other copy is marked.  Rows with a null id are left out, null
    texts and paths give no evidence, files delivered twice count once.
    """
    rows = files.select(
        F.col(file_id).alias("file"), F.col(repository_id).alias("repo"), F.col(path).alias("path"), F.col(repository).alias("name"), F.col(text).alias("text")
    ).where(F.col("file").isNotNull())
    marks = rows.select("file", "repo", _marks(F.col("path"), F.col("name"), F.col("text")).alias("m")).select("file", "repo", "m.*")
    origin = F.coalesce("path_origin", "header_origin", "composition")
    evidence = F.when(F.col("path_origin").isNotNull(), "path").when(F.col("header_origin").isNotNull(), "header").when(F.col("composition").isNotNull(), "composition")
    marked = cut_lineage(marks.select("file", "repo", origin.alias("origin"), evidence.alias("evidence")).groupBy("file").agg(F.min("repo").alias("repo"), F.max_by("origin", "evidence").alias("origin"), F.max("evidence").alias("evidence")))
    copies = copies_elsewhere(cut_lineage(line_hashes(rows).join(marked.select("file", "origin"), "file")))
    theirs = marked.select(F.col("file").alias("partner"), F.col("repo").alias("partner_repo"), F.col("origin").alias("partner_origin"))
    found = (
        marked.where(F.col("origin").isNull())
        .select("file", "repo")
        .join(copies.drop("origin"), "file")
        .join(theirs, "partner")
        .where(F.coalesce(F.col("partner_origin") == "vendored", F.lit(False)) | (F.col("partner_origin").isNull() & (F.col("partner_repo") < F.col("repo"))))
        .select("file", F.lit("vendored").alias("origin"), F.lit("containment").alias("evidence"))
        .distinct()
    )
    return marked.where(F.col("origin").isNotNull()).select("file", "origin", "evidence").unionByName(found).withColumnRenamed("file", "file_id")
