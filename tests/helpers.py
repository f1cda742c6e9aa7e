"""Sequential models of the operators, one change at a time, to hold the set forms against."""

from __future__ import annotations

import random

from tidemark.model import CHANGES_DDL


class Model:
    """A replica that applies changes one by one."""

    def __init__(self, node: int = 9):
        self.node, self.clock, self.cells, self.tombs = node, 0, {}, {}

    def merge(self, changes: list[tuple]) -> list[tuple]:
        accepted = []
        for seq, rid, op, col, value, cv, db, node, _, flags in changes:
            self.clock = max(self.clock, db) + 1
            if rid in self.tombs:
                continue
            if op == "del_record":
                self.cells = {k: v for k, v in self.cells.items() if k[0] != rid}
                self.tombs[rid] = (db, node, self.clock)
            else:
                old = self.cells.get((rid, col))
                if old and (cv, db, node) <= old[2:5]:
                    continue
                self.cells[rid, col] = (value if op == "put" else None, op == "put", cv, db, node, self.clock)
            accepted.append((seq, rid, op, col, value, cv, db, node, self.clock, flags))
        return accepted

    def apply(self, ops: list[tuple]) -> list[tuple]:
        out, calls = [], set()
        for seq, call, op, rid, col, value, flags in ops:
            cell = self.cells.get((rid, col))
            if op == "put":
                if call not in calls:
                    self.clock += 1
                    calls.add(call)
                if rid in self.tombs:
                    continue
            elif rid in self.tombs or op == "del_field" and not (cell and cell[1]):
                continue
            else:
                self.clock += 1
            if op == "del_record":
                self.cells = {k: v for k, v in self.cells.items() if k[0] != rid}
                self.tombs[rid] = (self.clock, self.node, self.clock)
                out.append((seq, rid, op, None, None, 9223372036854775807, self.clock, self.node, self.clock, flags))
            else:
                version = cell[2] + 1 if cell else 1
                self.cells[rid, col] = (value if op == "put" else None, op == "put", version, self.clock, self.node, self.clock)
                out.append((seq, rid, op, col, value if op == "put" else None, version, self.clock, self.node, self.clock, flags))
        return out


def random_changes(rng: random.Random, n: int, start: int = 1) -> list[tuple]:
    out = []
    for seq in range(start, start + n):
        op = rng.choices(["put", "del_field", "del_record"], [12, 3, 1])[0]
        rid = f"r{rng.randrange(6)}"
        col = None if op == "del_record" else f"c{rng.randrange(3)}"
        db = rng.randrange(1, 20)
        out.append((seq, rid, op, col, str(rng.randrange(50)) if op == "put" else None, rng.randrange(1, 5), db, rng.randrange(1, 4), db, 0))
    return out


def random_ops(rng: random.Random, n: int, start: int = 1) -> list[tuple]:
    out, call = [], 0
    for seq in range(start, start + n):
        op = rng.choices(["put", "del_field", "del_record"], [8, 4, 1])[0]
        same = op == "put" and out and out[-1][2] == "put" and rng.random() < 0.4
        call += not same
        rid = out[-1][3] if same else f"r{rng.randrange(6)}"
        col = None if op == "del_record" else f"c{seq % 7 if same else rng.randrange(3)}"
        out.append((seq, call, op, rid, col, str(seq) if op == "put" else None, 0))
    return out


def changes(spark, rows: list[tuple]):
    return spark.createDataFrame(rows, CHANGES_DDL)


def cells_of(replica) -> dict:
    return {(r.record_id, r.col_name): (r.value, r.present, r.col_version, r.db_version, r.node_id, r.local_db_version) for r in replica.cells.collect()}


def tombs_of(replica) -> dict:
    return {r.record_id: (r.db_version, r.node_id, r.local_db_version) for r in replica.tombstones.collect()}


def rows_of(frame) -> list[tuple]:
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def put(seq, rid, col, value, cv=1, db=1, node=1):
    return (seq, rid, "put", col, value, cv, db, node, db, 0)


def del_record(seq, rid, db=1, node=1, cv=1):
    return (seq, rid, "del_record", None, None, cv, db, node, db, 0)


def del_field(seq, rid, col, cv=2, db=2, node=1):
    return (seq, rid, "del_field", col, None, cv, db, node, db, 0)
