"""Catalogs: where tables are, and their metadata documents. Files behind a document are read by ``reader``."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from dataclasses import dataclass
from glob import glob
from pathlib import Path
from typing import Protocol
from urllib.parse import quote

from ..config import Catalog as Settings
from .store import fetch_bytes, local_path, scheme_of


class TableNotFound(LookupError):
    pass


@dataclass(frozen=True)
class Document:
    """A table's metadata document, the bytes of all its metadata, and where its files may lie."""

    table_id: str
    text: str
    metadata_size_bytes: int | None = None
    folder: str | None = None
    warehouse: str | None = None


class Catalog(Protocol):
    def document(self, table_id: str) -> Document: ...

    def list_tables(self, namespace: str | None = None) -> list[str]: ...


class FilesystemCatalog:
    """Tables are folders with a ``metadata`` folder below a warehouse; ids are relative paths joined by dots."""

    def __init__(self, warehouse: str):
        self.warehouse = Path(local_path(warehouse))

    def folder(self, table_id: str) -> Path:
        direct = Path(table_id)
        if direct.is_absolute() and (direct / "metadata").is_dir():
            return direct
        return self.warehouse.joinpath(*table_id.split("."))

    def find_metadata(self, folder: Path) -> Path:
        """The document that version-hint.text names, else the one of the greatest version."""
        meta = folder / "metadata"
        hint = meta / "version-hint.text"
        if hint.is_file() and (named := meta / f"v{hint.read_text().strip()}.metadata.json").is_file():
            return named
        found = sorted(glob(f"{glob_escape(meta)}/v*.metadata.json")) or sorted(glob(f"{glob_escape(meta)}/*.metadata.json"))
        if not found:
            raise TableNotFound(f"no table metadata in {meta}")
        version = lambda p: int(m[1]) if (m := re.match(r"v(\d+)", os.path.basename(p))) else 0
        return Path(max(found, key=version) if len({version(p) for p in found}) > 1 else found[-1])

    def document(self, table_id: str) -> Document:
        folder = self.folder(table_id)
        path = self.find_metadata(folder)
        size = sum(p.stat().st_size for p in (folder / "metadata").iterdir() if p.is_file())
        return Document(table_id, path.read_text(), size, str(folder), str(self.warehouse))

    def list_tables(self, namespace: str | None = None) -> list[str]:
        top = self.warehouse / namespace if namespace else self.warehouse
        found = []
        for at, below, _ in os.walk(top):
            if "metadata" in below:
                found.append(".".join(Path(at).relative_to(self.warehouse).parts))
                below.clear()  # what is below a table is no table
        return sorted(f for f in found if f)


def glob_escape(path: Path) -> str:
    return re.sub(r"([*?[])", r"[\1]", str(path))


class RestCatalog:
    """The REST catalog protocol. Nested namespaces are joined by the unit separator."""

    def __init__(self, uri: str, prefix: str | None = None, token: str | None = None, fetch=fetch_bytes):
        self.base = f"{uri.rstrip('/')}/v1" + (f"/{prefix.strip('/')}" if prefix else "")
        self.token, self.fetch = token, fetch

    @staticmethod
    def identifier(table_id: str) -> tuple[str, str]:
        """(namespace as in a URL, table) of a dotted id."""
        space, dot, table = table_id.rpartition(".")
        if not dot or not space or not table:
            raise ValueError(f"not namespace.table: {table_id!r}")
        return "%1F".join(quote(p, safe="") for p in space.split(".")), quote(table, safe="")

    def _get(self, path: str) -> dict:
        return json.loads(self.fetch(f"{self.base}/{path}", token=self.token))

    def document(self, table_id: str) -> Document:
        space, table = self.identifier(table_id)
        try:
            got = self._get(f"namespaces/{space}/tables/{table}")
        except OSError as e:
            if getattr(e, "code", None) == 404:
                raise TableNotFound(table_id) from e
            raise
        return Document(table_id, json.dumps(got.get("metadata", got)))

    def list_tables(self, namespace: str | None = None) -> list[str]:
        spaces = [namespace.split(".")] if namespace else self._get("namespaces").get("namespaces", [])
        out = []
        for s in spaces:
            try:
                got = self._get(f"namespaces/{'%1F'.join(quote(p, safe='') for p in s)}/tables")
            except OSError:
                continue  # a namespace that can't be listed does not hide the others
            out += [".".join([*i.get("namespace", s), i["name"]]) for i in got.get("identifiers", [])]
        return out


class GlueCatalog:
    """Tables of a Glue catalog that have a ``metadata_location``. Needs boto3."""

    def __init__(self, region: str | None = None, client=None):
        if client is None:
            try:
                import boto3
            except ImportError:
                raise NotImplementedError("the Glue catalog needs boto3, which is not installed") from None
            client = boto3.client("glue", region_name=region)
        self.client = client

    def document(self, table_id: str) -> Document:
        database, dot, name = table_id.rpartition(".")
        if not dot:
            raise ValueError(f"not database.table: {table_id!r}")
        place = self.client.get_table(DatabaseName=database, Name=name)["Table"].get("Parameters", {}).get("metadata_location")
        if not place:
            raise TableNotFound(f"{table_id} has no metadata_location")
        from pyspark.sql import SparkSession

        return Document(table_id, fetch_bytes(place, SparkSession.getActiveSession()).decode())

    def _pages(self, method: str, key: str, **args) -> Iterable[dict]:
        token = None
        while True:
            got = getattr(self.client, method)(**args, **({"NextToken": token} if token else {}))
            yield from got.get(key, [])
            if not (token := got.get("NextToken")):
                return

    def list_tables(self, namespace: str | None = None) -> list[str]:
        spaces = [namespace] if namespace else [d["Name"] for d in self._pages("get_databases", "DatabaseList")]
        return [f"{s}.{t['Name']}" for s in spaces for t in self._pages("get_tables", "TableList", DatabaseName=s) if t.get("Parameters", {}).get("metadata_location")]


def from_config(settings: Settings) -> Catalog:
    if settings.kind == "filesystem":
        return FilesystemCatalog(settings.warehouse or ".")
    if settings.kind == "rest":
        return RestCatalog(settings.uri or "", settings.prefix, settings.token)
    if settings.kind == "glue":
        return GlueCatalog(settings.region)
    raise ValueError(f"unknown catalog kind: {settings.kind}")


def resolve_path(path: str, folder: str | None, warehouse: str | None) -> str:
    """Where a file that metadata names lies, for tables that were moved to a local warehouse.

    In this order: the path itself; ``bucket/key`` as key below the warehouse; its name in the table's metadata
    folder; relative to the table; else as it is.
    """
    plain = local_path(path)
    if folder is None or (scheme_of(path) in ("", "file") and os.path.isabs(plain) and os.path.exists(plain)):
        return plain if scheme_of(path) in ("", "file") else path
    tries = []
    if scheme_of(path) in ("s3", "s3a", "s3n") and warehouse:
        tries.append(os.path.join(warehouse, path.split("://", 1)[1].partition("/")[2]))
    name = plain.rsplit("/", 1)[-1]
    tries += [os.path.join(folder, "metadata", name), os.path.join(folder, plain.lstrip("/"))]
    return next((t for t in tries if os.path.exists(t)), path)
