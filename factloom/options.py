"""Options of an extraction, their implications, and the key under which its dispatch is stored."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, fields
from pathlib import Path

from .functions.classify import MOCK_SEGMENTS, PB_SEGMENTS, segments


class UsageError(ValueError):
    """Options that don't go together; exit code 2."""


class NoContracts(Exception):
    """Nothing at any boundary was found though some was required; exit code 3."""


@dataclass(frozen=True)
class Options:
    repo: str = ""
    scope: str = "./..."
    out: str = ""
    mode: str = "main"
    base: str = ""
    head: str = ""
    verbose: bool = False
    allow_missing_scope: bool = False
    include_mocks: bool = False
    dispatch: str = "vta"
    cap: int = 10
    snapshot_store: str = ""
    field_paths: bool = True
    closure_flow: bool = True
    container_writes: bool = True
    library_writeback: bool = True
    heap_slots: bool = False
    heap_slots_scope: str = "chan"
    heap_iface_narrow: bool = False
    heap_iface_identity: bool = True
    heap_iface_drop: bool = False
    error_results: bool = False
    error_results_strict: bool = False
    pb_paths: str = ",".join(PB_SEGMENTS)
    mock_paths: str = ",".join(MOCK_SEGMENTS)
    require_contracts: bool = False
    canonical_instance_ids: bool = True
    surface_reads: bool = True
    http_routes: bool = True
    http_calls: bool = True
    topic_cells: bool = True
    http_seed_request: bool = False
    byref_out: bool = False
    dep_impls: bool = True
    dep_bodies: bool = False
    dependency_sums: str = ""

    def __post_init__(self):
        if self.mode not in ("main", "mr"):
            raise UsageError(f"mode must be main or mr, not {self.mode!r}")
        if self.mode == "mr" and not (self.base and self.head):
            raise UsageError("mode mr needs base and head")
        if self.dispatch not in ("", "off", "vta", "cha"):
            raise UsageError(f"dispatch must be off, vta or cha, not {self.dispatch!r}")
        if self.heap_slots and self.heap_slots_scope not in ("chan", "all"):
            raise UsageError(f"heap_slots_scope must be chan or all, not {self.heap_slots_scope!r}")
        segments(self.pb_paths), segments(self.mock_paths)

    # what only counts together with another option
    @property
    def heap_all_fields(self) -> bool:
        return self.heap_slots and self.heap_slots_scope == "all"

    @property
    def narrow(self) -> bool:
        return self.heap_slots and self.heap_iface_narrow

    @property
    def narrow_by_identity(self) -> bool:
        return self.narrow and self.heap_iface_identity

    @property
    def drop_ifaces(self) -> bool:
        return self.heap_slots and self.heap_iface_drop

    @property
    def strict_errors(self) -> bool:
        return self.error_results and self.error_results_strict

    def key(self) -> str:
        """Hex SHA-256 over everything that shapes stored dispatch, each field framed by its big-endian length."""
        skipped = {"out", "mode", "base", "head", "verbose", "allow_missing_scope", "snapshot_store", "require_contracts"}
        h = hashlib.sha256()
        for value in [code_digest(), *[getattr(self, f.name) for f in fields(self) if f.name not in skipped]]:
            text = (str(value).lower() if isinstance(value, bool) else str(value)).encode()
            h.update(len(text).to_bytes(8, "big") + text)
        return h.hexdigest()


#: The version of this library.
VERSION = "0.2.0"


def version(name: str = "factloom", runtime: str | None = None) -> str:
    """``name version (runtime)``; the runtime is Spark's own unless one is given."""
    import pyspark

    return f"{name} {VERSION} (spark {runtime or pyspark.__version__})"


_digest: list[str] = []


def code_digest() -> str:
    """Hex SHA-256 over this package's sources: other code, other snapshots."""
    if not _digest:
        h = hashlib.sha256()
        root = Path(__file__).parent
        for p in sorted(root.rglob("*.py")):
            if "llm" not in p.relative_to(root).parts:
                h.update(p.read_bytes())
        _digest.append(h.hexdigest())
    return _digest[0]


def exit_code(error: BaseException | None) -> int:
    return 0 if error is None else 3 if isinstance(error, NoContracts) else 2 if isinstance(error, UsageError) else 1
