"""Commands: python -m noteloom COMMAND [ARGUMENT...] [--vault PATH] [--as-of DAY] [--limit N] [--shared PATH --personal PATH] [--confirm]."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from . import rpc
from .memory import Memory
from .operators import catalogue as C
from .session import build

COMMANDS = {
    "init": lambda m, a: m.init(), "status": lambda m, a: rpc._status(m, {}), "session-start": lambda m, a: m.session_start(),
    "classify": lambda m, a: rpc._classify(m, {"message": a.words[0]}), "search": lambda m, a: m.search(a.words[0], a.limit, wing=a.wing, room=a.room),
    "orphans": lambda m, a: m.find_orphans().select("rel_path"), "wrap-up": lambda m, a: m.stop(), "wings": lambda m, a: m.catalogue().wings,
    "rooms": lambda m, a: C.room_counts(m.catalogue()).where(F.col("wing") == a.words[0]), "tunnel": lambda m, a: rpc._tunnel(m, dict(zip(("wing_a", "wing_b", "room"), a.words))),
    "kg-query": lambda m, a: m.kg_query(a.words[0], a.as_of), "kg-timeline": lambda m, a: m.kg_timeline(a.words[0]), "kg-stats": lambda m, a: m.kg_stats(),
    "validate": lambda m, a: m.validate().where(F.size("warnings") > 0), "rebuild-index": lambda m, a: m.rebuild_index(), "kg-populate": lambda m, a: m.kg_populate(),
    "sync": lambda m, a: m.sync(), "write": lambda m, a: rpc._write(m, {"content": a.words[0], "tags": a.tags, "file_path": a.path}),
    "export": lambda m, a: rpc._two(m, _vaults(a)).export(a.words, confirm=not a.confirm), "import": lambda m, a: rpc._two(m, _vaults(a)).import_notes(a.words),
    "migrate": lambda m, a: m.migrate(a.shared, a.personal, config_path=a.config), "brain": lambda m, a: m.update_brain(a.words[0], a.words[1]),
    "template": lambda m, a: m.from_template(a.words[0], a.path, dict(x.split("=", 1) for x in a.words[1:])),
}


def _vaults(a) -> dict:
    return {"shared_vault_path": a.shared, "personal_vault_path": a.personal}


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="noteloom", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("words", nargs="*")
    for name, kind in (("vault", str), ("as-of", str), ("limit", int), ("wing", str), ("room", str), ("tags", str), ("path", str), ("shared", str), ("personal", str), ("config", str)):
        p.add_argument(f"--{name}", type=kind, default={"vault": ".", "limit": 5}.get(name))
    p.add_argument("--confirm", action="store_true", help="export now instead of a preview")
    a = p.parse_args(argv)
    out = COMMANDS[a.command](Memory(build(), a.vault), a)
    out.show(100, truncate=80) if hasattr(out, "show") else print(out)


if __name__ == "__main__":
    main()
