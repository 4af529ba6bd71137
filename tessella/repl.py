"""A line-based shell: statements end with a semicolon, lines that begin with a dot are commands.

``python -m tessella.repl [folder]`` starts it.  Handles are called A, B, ... and
share one database, so concurrent transactions can be tried from one shell.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import SparkSession

from tessella.connection import Connection, connect, split_script
from tessella.errors import EngineError, GeneralError, NotImplementedFeature

HELP = {
    ".help": "show this list",
    ".open FOLDER": "open a database folder, made if it is missing; other handles close",
    ".save FOLDER": "write the current database to a folder, in place of what it holds",
    ".tables": "names of the tables",
    ".ask QUESTION": "not available: needs a language model",
    ".spawn": "another handle on the same database, and switch to it",
    ".use NAME": "switch to a handle",
    ".conns": "all handles",
    ".exit": "leave",
}


def save(connection: Connection, folder: str) -> None:
    """Write every table of a database to another folder, files in parallel."""
    db = connection._db
    if db.store.path in (folder, f"file://{folder}"):
        db.publish()
        return

    def copy(session) -> None:
        session.tables.clear()
        for name, t in connection.tables.items():
            session.tables[name] = replace(t, files=session.write(t, t.frame(db.spark)) if t.files else (), segments=())

    with Connection.open(folder, db.spark) as other:
        other._write(copy, declares=True)


class Shell:
    """Handles by name, the active one, and what has been typed of a statement."""

    def __init__(self, spark: SparkSession | None = None, folder: str | None = None):
        self.handles: dict[str, Connection] = {"A": connect(folder, spark)}
        self.active, self.typed, self.over = "A", "", False
        self.spark = self.connection._db.spark

    @property
    def connection(self) -> Connection:
        return self.handles[self.active]

    def line(self, text: str) -> str:
        """Take a line; what is to be shown, an error as text."""
        try:
            if not self.typed and text.startswith("."):
                return self.command(text)
            self.typed += text + "\n"
            if not text.rstrip().endswith(";"):
                return ""
            script, self.typed = self.typed, ""
            shown = [self.connection.execute_with_render(sql) for sql in split_script(script)]
            return "\n".join(part for out in shown for part in (out.rendered, out.status) if part)
        except EngineError as e:
            return f"error: {e}"

    def command(self, text: str) -> str:
        name, _, rest = text.strip().partition(" ")
        given = rest.strip()
        match name, given:
            case ".help", _:
                return "\n".join(f"{k:<15} {v}" for k, v in HELP.items())
            case ".exit", _:
                self.close()
                return ""
            case ".tables", _:
                return "\n".join(sorted(self.connection.tables)) or "(no tables)"
            case ".open", folder if folder:
                opened = connect(folder, self.spark)
                self.close()
                self.handles, self.active, self.over = {"A": opened}, "A", False
                return f"Opened '{folder}' ({len(opened.tables)} table{'' if len(opened.tables) == 1 else 's'})."
            case ".save", folder if folder:
                save(self.connection, folder)
                return f"Saved database to '{folder}'."
            case ".ask", question if question:
                raise NotImplementedFeature(".ask needs a language model, which this engine doesn't have")
            case ".spawn", _:
                n = len(self.handles)
                fresh = chr(ord("A") + n) if n < 26 else f"H{n}"
                self.handles[fresh] = self.connection.connect()
                self.active = fresh
                return f"Handle '{fresh}' is active; {len(self.handles)} handles open."
            case ".use", wanted if wanted:
                found = next((h for h in self.handles if h.lower() == wanted.lower()), None)
                if found is None:
                    raise GeneralError(f"no handle '{wanted}': see .conns")
                self.active = found
                return f"Active handle: '{found}'."
            case ".conns", _:
                return "\n".join(f"{'*' if h == self.active else ' '} {h}{' (BEGIN CONCURRENT)' if c.concurrent_tx_is_open() else ''}" for h, c in self.handles.items())
        raise GeneralError("unknown command or missing argument: see .help")

    def close(self) -> None:
        for c in self.handles.values():
            c.close()
        self.over = True


def run(lines: Iterable[str], shell: Shell, out=sys.stdout) -> None:
    """Feed lines to a shell until it is over."""
    for text in lines:
        if shown := shell.line(text.rstrip("\n")):
            print(shown, file=out)
        if shell.over:
            return
    shell.close()


if __name__ == "__main__":
    run(sys.stdin, Shell(folder=sys.argv[1] if len(sys.argv) > 1 else None))
