"""Queries, judgements and patches that the registered queries run with."""

from __future__ import annotations

QUERIES = [
    (0, "how does the session reach the ledger header"),
    (1, "restore the stale index of a cursor"),
    (2, "which packet keeps the lattice sorted"),
    (3, "error when the quorum expired"),
    (4, "copy the bounded mortar mortar into the vessel"),
]
PHRASE_QUERIES = [(0, "corekit_telemetry"), (1, "all_rights_reserved quiver"), (2, "raise_valueerror if_not")]
#: (query, relevant, irrelevant keywords): ten judged queries.
JUDGMENTS = [
    ("how does the session reach the ledger header", ["session", "ledger", "header"], ["css"]),
    ("restore the stale index of a cursor", ["restore", "index", "cursor"], ["deprecated"]),
    ("which packet keeps the lattice sorted", ["packet", "lattice"], []),
    ("error when the quorum expired", ["quorum", "expired", "error"], ["todo"]),
    ("copy the bounded mortar mortar into the vessel", ["mortar", "vessel"], ["fixme"]),
    ("decode the frozen keyring of a channel", ["keyring", "channel", "frozen"], ["test"]),
    ("what merges a shallow branch with its batch", ["branch", "batch", "merge"], []),
    ("telemetry of the worker endpoint", ["telemetry", "endpoint"], ["mock"]),
    ("validate flange before the packet is sent", ["flange", "validate"], ["deprecated"]),
    ("rotate the granule of a pending bucket", ["granule", "bucket", "rotate"], []),
]
JUDGED_QUERIES = [(i, q) for i, (q, _, _) in enumerate(JUDGMENTS)]
JUDGED = [(i, relevant, irrelevant) for i, (_, relevant, irrelevant) in enumerate(JUDGMENTS)]
#: Thirteen queries of all shapes: words, phrases, code, questions, and what matches nothing.
STRESS = [
    "telemetry", "quorum error", "ledger", "where is the cursor restored", "find the main endpoint", "what validates a packet header",
    "i need to understand how the session combines the ledger with the stale index of a cursor", "what happens between the first request and the sealed packet that leaves the vessel",
    "def restore_cursor", "class PacketLattice", "import corekit.telemetry", "???", "zzzz qqqq",
]
STRESS_QUERIES = list(enumerate(STRESS))


BLOCK = "<<<<<<< SEARCH\n{0}\n=======\n{1}\n>>>>>>> REPLACE\n"


def patch_tables(spark):
    files = [("a.py", "def f():\n    return 1\n\n\ndef g():\n    return 2\n"), ("b.py", "x = 1\nx = 1\n"), ("c.py", "y = 2\n")]
    patches = [("a.py", BLOCK.format("return 1", "return 10") + "@@FUNCTION g\ndef g():\n    return 20\n@@END\n"), ("b.py", BLOCK.format("x = 1", "x = 3"))]
    return spark.createDataFrame(files, "file string, content string"), spark.createDataFrame(patches, "file string, patch string")
