"""Scalar functions and predicates of the workspace model as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions read as native text, never converted (fixed values).
TEXT_EXTENSIONS = tuple(
    """
    md markdown mdx txt text rst adoc log csv tsv json jsonl ndjson yaml yml toml
    ini cfg conf env py pyi rs go js jsx ts tsx c h cc cpp hpp cs java kt kts rb
    php swift scala sh bash zsh sql graphql proto tex bib
    """.split()
)
#: Object kinds by their four-byte tag (fixed values).
OBJECT_TAGS = {"ORGM": "manifest", "ORGT": "tree", "ORGC": "commit", "ORGR": "refs", "ORGS": "store", "ORGP": "pack", "ORGI": "index"}
FORMAT_VERSION = 1


# paths -------------------------------------------------------------------------------------------------------------


def path_parts(path: Column) -> Column:
    """The non-empty components of an absolute path; null for a relative one."""
    return F.when(path.startswith("/"), F.filter(F.split(path, "/"), lambda x: x != ""))


def component_ok(name: Column) -> Column:
    """A usable file name: not empty, not . or .., no slash, no NUL."""
    return F.coalesce((name != "") & (name != ".") & (name != "..") & ~name.contains("/") & ~name.contains("\0"), F.lit(False))


def ref_name_ok(name: Column) -> Column:
    """A usable ref name: at most 255 bytes, no control or white space, none of the reserved characters or forms."""
    bad = name.rlike(r"(?U)[\p{Cntrl}\s~^:?*\[\\]") | name.contains("..") | name.contains("@{") | name.contains("//")
    edges = name.rlike(r"^[-/]|[/.]$|\.lock$|(^|/)\.(/|$)")
    return F.coalesce((name != "") & (name != "@") & (F.octet_length(name) <= 255) & ~bad & ~edges, F.lit(False))


def lock_path_ok(path: Column) -> Column:
    return F.coalesce(path.startswith("/") & ~path.contains("\0"), F.lit(False))


def parent_path(path: Column) -> Column:
    """The directory of a path; / for what lies in the root."""
    cut = F.regexp_replace(path, "/+[^/]+/*$", "")
    return F.when(cut == "", F.lit("/")).otherwise(cut)


def base_name(path: Column) -> Column:
    return F.element_at(path_parts(path), -1)


def normal_dir(path: Column) -> Column:
    """Trimmed, a leading slash, no trailing ones; / for the root."""
    bare = F.rtrim(F.trim(path), F.lit("/"))
    return F.when(bare == "", F.lit("/")).when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))


def join_path(parent: Column, name: Column) -> Column:
    return F.when(parent == "/", F.concat(F.lit("/"), name)).otherwise(F.concat(parent, F.lit("/"), name))


def extension(path: Column) -> Column:
    """Lower-cased, after a last dot that lies behind the last slash; empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def document_extension(path: Column) -> Column:
    """The rule for converted documents: of the base name only, and empty where it has no dot."""
    name = F.substring_index(path, "/", -1)
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def has_extension(path: Column, extensions: list[str]) -> Column:
    wanted = [e.lower().lstrip(".") for e in extensions]
    return F.lit(True) if not wanted else path.rlike(r"\.[^./]*$") & extension(path).isin(wanted)


def under(path: Column, root: str) -> Column:
    """The path is root, or lies below it."""
    bare = "/" + root.strip("/")
    return F.lit(True) if bare == "/" else (path == bare) | path.startswith(bare + "/")


def within_size(size: Column, cap: int = 0) -> Column:
    """Not empty, and at most cap bytes (0: any)."""
    return (size > 0) & ((size <= cap) if cap else F.lit(True))


def theirs_path(path: Column) -> Column:
    return F.concat(path, F.lit(".theirs"))


def sidecar_path(path: Column, folder: str = "/.coedit") -> Column:
    """Where a co-edited document keeps its state: the path's bytes in hexadecimal, so no folders nest."""
    return F.concat(F.lit(folder + "/"), F.lower(F.hex(path.cast("binary"))))


def mime_type(path: Column) -> Column:
    known = {
        "md": "text/markdown", "txt": "text/plain", "html": "text/html", "htm": "text/html", "json": "application/json",
        "csv": "text/csv", "xml": "text/xml", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg",
    }
    ext, out = document_extension(path), F.lit(None).cast("string")
    for e, mime in known.items():
        out = F.when(ext == e, F.lit(mime)).otherwise(out)
    return out


# bytes and text ----------------------------------------------------------------------------------------------------


def content_hash(data: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the bytes."""
    return F.sha2(data, 256)


def is_hash(text: Column) -> Column:
    """64 lower-case hexadecimal digits; upper case is refused."""
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def is_text(data: Column) -> Column:
    return F.is_valid_utf8(data)


def lossy_text(data: Column) -> Column:
    """UTF-8 with U+FFFD for what is not."""
    return F.make_valid_utf8(data)


def lines(text: Column) -> Column:
    """The lines with their line ends; the last may lack one; an empty text has none."""
    return F.regexp_extract_all(text, F.lit("[^\n]*\n|[^\n]+$"), F.lit(0))


def trimmed_line(line: Column) -> Column:
    """White space of any kind cut at both ends."""
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def slice_bytes(data: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end) of a binary; both within it."""
    return F.substring(data, start.cast("int") + 1, (end - start).cast("int"))


def utf16_length(text: Column) -> Column:
    """Code units: characters beyond the first plane count twice."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[\x{0}-\x{FFFF}]", ""))


def occurrences(text: Column, old: Column) -> Column:
    """How often old occurs, without overlaps; 0 for an empty old."""
    return F.when(old == "", 0).otherwise(((F.length(text) - F.length(F.replace(text, old, F.lit("")))) / F.length(old)).cast("int"))


def replaced(text: Column, old: Column, new: Column, every: bool = False) -> Column:
    """text with old replaced; null where old is missing, or occurs more than once and not every one is wanted."""
    n = occurrences(text, old)
    return F.when((n == 1) | ((n > 1) & F.lit(every)), F.replace(text, old, new))


def splice(data: Column, offset: Column, new: Column) -> Column:
    """data with new written at offset; a gap before it is filled with zeros."""
    size = F.octet_length(data)
    head = F.when(size >= offset, F.substring(data, F.lit(1), offset.cast("int"))).otherwise(F.concat(data, zeros(offset - size)))
    rest = F.greatest(size - offset - F.octet_length(new), F.lit(0)).cast("int")
    tail = F.when(rest > 0, F.substring(data, (size - rest + 1).cast("int"), rest)).otherwise(F.unhex(F.lit("")))
    return F.concat(head, new, tail)


def truncated(data: Column, size: Column) -> Column:
    """data cut to size, or extended to it with zeros."""
    own = F.octet_length(data)
    return F.when(own >= size, F.substring(data, F.lit(1), size.cast("int"))).otherwise(F.concat(data, zeros(size - own)))


def zeros(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), F.greatest(n, F.lit(0)).cast("int")))


# ranges ------------------------------------------------------------------------------------------------------------


def slice_bounds(start: Column, end: Column, size: Column) -> tuple[Column, Column]:
    """[start:end] as Python slices it: negative counts from the end, null is open, reversed is empty."""
    a = F.when(start.isNull(), F.lit(0)).when(start < 0, F.greatest(size + start, F.lit(0))).otherwise(F.least(start, size))
    b = F.when(end.isNull(), size).when(end < 0, F.greatest(size + end, F.lit(0))).otherwise(F.least(end, size))
    return a, F.greatest(a, b)


def http_range(header: Column, size: Column) -> Column:
    """struct(status, start, end) of a Range header: partial with [start, end), full where it is none (or several), or
    unsatisfiable."""
    pattern = r"^bytes=\s*(\d*)-(\d*)\s*$"
    first, last = (F.try_to_number(F.regexp_extract(header, pattern, k), F.lit("9" * 18)).cast("long") for k in (1, 2))
    one = F.coalesce(header.rlike(pattern), F.lit(False)) & (first.isNotNull() | last.isNotNull())
    suffix = first.isNull()
    start = F.when(suffix, F.greatest(size - last, F.lit(0))).otherwise(first)
    end = F.when(suffix | last.isNull(), size).otherwise(F.least(last + 1, size))
    wrong = F.when(suffix, (last == 0) | (size == 0)).otherwise((first >= size) | (last.isNotNull() & (last < first)))
    nothing = F.lit(None).cast("long")
    return (
        F.when(~one, F.struct(F.lit("full").alias("status"), F.lit(0).cast("long").alias("start"), size.cast("long").alias("end")))
        .when(F.coalesce(wrong, F.lit(False)), F.struct(F.lit("unsatisfiable").alias("status"), nothing.alias("start"), nothing.alias("end")))
        .otherwise(F.struct(F.lit("partial").alias("status"), start.cast("long").alias("start"), end.cast("long").alias("end")))
    )


# enumerations and records ------------------------------------------------------------------------------------------


def may_write(policy: Column) -> Column:
    """Only 0 is open; any other policy, also an unknown one, is restrictive."""
    return F.coalesce(policy == 0, F.lit(False))


def suggestion_status(text: Column) -> Column:
    return F.when(text.isin("pending", "accepted", "rejected", "superseded"), text)


def suggestion_kind(text: Column) -> Column:
    return F.when(text.isin("bytes", "delete", "crdt"), text)


def encode_runs(runs: Column) -> Column:
    """Blame runs as ``actor,session,len`` joined by semicolons; a null session is 0."""
    return F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["actor"], F.coalesce(r["session"], F.lit(0)), r["len"])), ";")


def decode_runs(text: Column) -> Column:
    """The runs of an encoded map; malformed segments are dropped."""
    good = F.filter(F.split(text, ";"), lambda s: s.rlike(r"^\d+,\d+,\d+$"))

    def run(s: Column) -> Column:
        p = F.split(s, ",")
        return F.struct(p[0].cast("long").alias("actor"), p[1].cast("long").alias("session"), p[2].cast("long").alias("len"))

    return F.transform(good, run)


def runs_well_formed(text: Column) -> Column:
    """Whether every segment is well formed (carrying blame between stores refuses the whole map else)."""
    return F.coalesce((text == "") | text.rlike(r"^\d+,\d+,\d+(;\d+,\d+,\d+)*;?$"), F.lit(False))


def symbolic_ref(value: Column) -> Column:
    """The name that a symbolic ref points to; null for a hash."""
    return F.when(value.startswith("ref:"), F.trim(F.substring(value, 5, 1_000)))


def first_parent(parents: Column) -> Column:
    return F.get(parents, F.lit(0))


def object_kind(data: Column) -> Column:
    """The kind that an object's tag tells; null for a chunk."""
    tag, out = F.substring(data, 1, 4), F.lit(None).cast("string")
    for own, kind in OBJECT_TAGS.items():
        out = F.when(tag == F.lit(own).cast("binary"), F.lit(kind)).otherwise(out)
    return out


def object_state(data: Column) -> Column:
    """ok, unsupported (a newer version), corrupt (version 0 or cut), or raw for a chunk."""
    version = F.conv(F.hex(F.substring(data, 5, 1)), 16, 10).cast("int")
    return (
        F.when(object_kind(data).isNull(), F.lit("raw"))
        .when(version > FORMAT_VERSION, F.lit("unsupported"))
        .when(F.coalesce(version, F.lit(0)) == 0, F.lit("corrupt"))
        .otherwise(F.lit("ok"))
    )


# git ---------------------------------------------------------------------------------------------------------------


def git_object(kind: str, payload: Column) -> Column:
    """A loose object's bytes: kind, length, NUL, payload."""
    head = F.concat(F.lit(f"{kind} "), F.octet_length(payload).cast("string")).cast("binary")
    return F.concat(head, F.unhex(F.lit("00")), payload)


def git_oid(kind: str, payload: Column, sha256: bool = False) -> Column:
    own = git_object(kind, payload)
    return F.sha2(own, 256) if sha256 else F.sha1(own)


def git_ident(author: Column, domain: str = "workspace.local") -> Column:
    """``Name <mail>``: an author that has both brackets stays, another gets an address of the domain."""
    return F.when(author.contains("<") & author.contains(">"), author).otherwise(F.concat(author, F.lit(" <"), author, F.lit(f"@{domain}>")))


def git_tree_key(name: Column, is_dir: Column) -> Column:
    """What trees are ordered by: a directory's name has a slash behind it."""
    return F.when(is_dir, F.concat(name, F.lit("/"))).otherwise(name)


def git_mode(mode: Column) -> Column:
    """Normalised mode of an imported entry; null for a submodule, which is skipped."""
    return F.when(mode == "160000", F.lit(None)).when(mode.isin("40000", "040000"), F.lit("40000")).when(mode == "120000", mode).when(mode == "100755", mode).otherwise(F.lit("100644"))


def lfs_pointer(oid: Column, size: Column) -> Column:
    return F.concat(F.lit("version https://git-lfs.github.com/spec/v1\noid sha256:"), oid, F.lit("\nsize "), size.cast("string"), F.lit("\n"))


def lfs_oid(text: Column) -> Column:
    """The hash that a pointer names; null where the text is no pointer."""
    own = F.regexp_extract(text, r"^version https://git-lfs\.github\.com/spec/v1\n(?:.*\n)*?oid sha256:([0-9a-f]{64})\n", 1)
    return F.when(own != "", own)


def export_body(data: Column, threshold: int) -> Column:
    """What an export writes for a file: its bytes, or from the threshold on a pointer to them."""
    size = F.octet_length(data)
    return F.when(size >= threshold, lfs_pointer(F.sha2(data, 256), size).cast("binary")).otherwise(data)


def passage_metadata(path: Column, start: Column, end: Column, hash_: Column, source: Column) -> Column:
    """A passage's flat metadata for retrieval frameworks."""
    return F.create_map(
        F.lit("path"), path, F.lit("byte_start"), start.cast("string"), F.lit("byte_end"), end.cast("string"),
        F.lit("content_hash"), hash_, F.lit("source"), source,
    )
