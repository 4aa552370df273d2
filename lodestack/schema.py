"""Fixed schemas of the workspace model: one DataFrame per metadata table and per object kind, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "binary": T.BinaryType(),
}


def _struct(spec: str) -> T.StructType:
    """``name kind`` pairs; a kind with ! is not nullable."""
    fields = []
    for part in spec.split(","):
        name, kind = part.split()
        fields.append(T.StructField(name, _KINDS[kind.rstrip("!")], not kind.endswith("!")))
    return T.StructType(fields)


RUN = _struct("actor long, session long, len long")
BLAME_SPAN = _struct("line_start int, line_end int, byte_start long, byte_end long, actor long, session long")
CHUNK_REF = _struct("hash string, len long")

WORKSPACE = _struct("id long!, name string!, root_ino long!, created_at long")
INODE = _struct("ino long!, kind string!, mode long, nlink long, size long, content_hash string, mtime long, ctime long, workspace_id long!")
DENTRY = _struct("parent_ino long!, name string!, ino long!")
SYMLINK = _struct("ino long!, target string!")
REF = _struct("workspace_id long!, name string!, value string!")
CONFIG = _struct("workspace_id long!, key string!, value string")
CONFLICT = _struct("workspace_id long!, path string!, kind string!")
FILE_LOCK = _struct("workspace_id long!, path string!, owner string!, acquired_at long!")
ACTOR = _struct(
    "id long!, kind string!, display_name string, auth_subject string, agent_model string, agent_vendor string,"
    "controller_actor_id long, created_at long, write_policy int!"
)
SESSION = _struct("id long!, actor_id long!, client string, started_at long, ended_at long")
TOOL_CALLS = _struct("id long!, session_id long, actor_id long, name string!, parameters string, result string, error string, started_at long, completed_at long, duration_ms long")
EDIT_OP = _struct(
    "id long!, session_id long, actor_id long!, tool_call_id long, ino long!, path string!, op string!, byte_start long, byte_len long,"
    "pre_hash string, post_hash string, ts long!, workspace_id long!"
)
FS_EVENT = _struct("seq long!, actor_id long, session_id long, kind string!, path string!, detail string, ts long!, branch string, workspace_id long!")
PRESENCE = _struct("session_id long!, actor_id long!, path string, last_seen long!, workspace_id long!")
SUGGESTION = _struct(
    "id long!, actor_id long!, session_id long, branch string, path string!, base_hash string, proposed_hash string, summary string,"
    "status string!, created_ts long, resolved_ts long, resolved_by long, workspace_id long!, kind string!"
)
LIVE_DOC = _struct("workspace_id long!, path string!, session_id long, actor_id long!, content_hash string, since long!")
COEDIT_OP = _struct("id long!, workspace_id long!, path string!, payload binary, ts long!")

BLOB_BLAME = T.StructType([T.StructField("workspace_id", T.LongType(), False), T.StructField("content_hash", T.StringType(), False), T.StructField("runs", T.ArrayType(RUN))])
CHUNKS = _struct("hash string!, len long!, bytes binary!")
MANIFESTS = T.StructType([T.StructField("mhash", T.StringType(), False), T.StructField("size", T.LongType(), False), T.StructField("chunks", T.ArrayType(CHUNK_REF))])
TREE_ENTRIES = _struct("tree_hash string!, name string!, mode long!, kind string!, hash string!")
COMMITS = T.StructType(
    [
        T.StructField("hash", T.StringType(), False),
        T.StructField("tree", T.StringType(), False),
        T.StructField("parents", T.ArrayType(T.StringType())),
        T.StructField("author", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("ts", T.LongType()),
    ]
)
REF_SNAPSHOTS = _struct("workspace string!, generation long!, name string!, value string!")
PACK_INDEX = _struct("hash string!, pack string!, offset long!, len long!")
PASSAGES = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("byte_start", T.LongType(), False),
        T.StructField("byte_end", T.LongType(), False),
        T.StructField("hash", T.StringType(), False),
        T.StructField("text", T.BinaryType()),
        T.StructField("blame", T.ArrayType(BLAME_SPAN)),
    ]
)

TABLES = {
    "workspace": WORKSPACE, "inode": INODE, "dentry": DENTRY, "symlink": SYMLINK, "ref": REF, "config": CONFIG,
    "conflict": CONFLICT, "file_lock": FILE_LOCK, "actor": ACTOR, "session": SESSION, "tool_calls": TOOL_CALLS,
    "edit_op": EDIT_OP, "fs_event": FS_EVENT, "presence": PRESENCE, "suggestion": SUGGESTION, "live_doc": LIVE_DOC,
    "coedit_op": COEDIT_OP, "blob_blame": BLOB_BLAME, "chunks": CHUNKS, "manifests": MANIFESTS,
    "tree_entries": TREE_ENTRIES, "commits": COMMITS, "ref_snapshots": REF_SNAPSHOTS, "pack_index": PACK_INDEX,
    "passages": PASSAGES,
}
