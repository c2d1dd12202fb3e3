"""Searching data portals for tables.

A provider yields descriptors ``(ref, csv_path, title)`` of datasets that hold exactly one CSV file.  Clients are
passed in, so that nothing here needs a network or a portal's library until it is used.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

log = logging.getLogger(__name__)
SCHEMA = "ref string, csv_path string, title string"


class Dataset(NamedTuple):
    ref: str
    csv_path: str
    title: str


class Listing(NamedTuple):
    """A portal's entry: its reference, title and file names."""

    ref: str
    title: str
    files: tuple[str, ...]


class Provider:
    """A portal: ``listings`` in the portal's order, ``fetch`` puts a file into a folder and returns its path."""

    def __init__(self, listings: Callable[[str, int], Iterator[Listing]], fetch: Callable[[Listing, str, Path], str]):
        self.listings, self.fetch = listings, fetch

    def search(self, term: str, folder: Path, topn: int) -> Iterator[Dataset]:
        """Up to ``topn`` datasets with one CSV file; a dataset that fails is logged and passed over."""
        found = 0
        for listing in self.listings(term, topn):
            if found >= topn:
                return
            csvs = [f for f in listing.files if f.lower().endswith(".csv")]
            if len(csvs) != 1:
                continue
            try:
                path = self.fetch(listing, csvs[0], folder)
            except Exception as error:
                log.warning("%s is passed over: %s", listing.ref, error)
                continue
            found += 1
            yield Dataset(listing.ref, path, listing.title)


def zenodo_provider(get: Callable[..., Any] | None = None) -> Provider:
    """Zenodo's public records; ``get`` is ``requests.get`` or a stand-in."""

    def http(*args, **kwargs):
        if get is not None:
            return get(*args, **kwargs)
        import requests

        return requests.get(*args, **kwargs)

    links: dict[tuple[str, str], str] = {}

    def listings(term: str, topn: int) -> Iterator[Listing]:
        query = {"q": term, "size": topn * 3, "sort": "newest", "type": "dataset"}
        try:
            reply = http("https://zenodo.org/api/records", params=query, timeout=30)
            reply.raise_for_status()
            hits = reply.json()["hits"]["hits"]
        except Exception as error:
            log.warning("the search failed: %s", error)
            return
        for hit in hits:
            try:
                ref, files = f"zenodo__{hit['id']}", {f["key"]: f["links"]["self"] for f in hit.get("files", ())}
                listing = Listing(ref, (hit.get("metadata") or {}).get("title", ""), tuple(files))
            except (KeyError, TypeError, AttributeError) as error:
                log.warning("a record without %s is passed over", error)
                continue
            links.update({(ref, name): link for name, link in files.items()})
            yield listing

    def fetch(listing: Listing, name: str, folder: Path) -> str:
        target = folder / listing.ref / Path(name).name
        target.parent.mkdir(parents=True, exist_ok=True)
        with http(links[listing.ref, name], stream=True, timeout=120) as reply:
            reply.raise_for_status()
            with target.open("wb") as out:
                for chunk in reply.iter_content(chunk_size=1 << 13):
                    out.write(chunk)
        return str(target)

    return Provider(listings, fetch)


def kaggle_provider(client: Any = None) -> Provider:
    """Kaggle's datasets, hottest first; ``client`` is the portal's authenticated API object or a stand-in."""

    def api():
        if client is not None:
            return client
        from kaggle.api.kaggle_api_extended import KaggleApi

        own = KaggleApi()
        own.authenticate()
        return own

    def listings(term: str, topn: int) -> Iterator[Listing]:
        portal = api()
        for d in portal.dataset_list(search=term, file_type="csv", sort_by="hottest"):
            try:
                files = tuple(f.name for f in portal.dataset_list_files(d.ref).files)
            except Exception as error:
                log.warning("%s is passed over: %s", d.ref, error)
                continue
            yield Listing(d.ref, d.title, files)

    def fetch(listing: Listing, name: str, folder: Path) -> str:
        target = folder / listing.ref.replace("/", "__")
        target.mkdir(parents=True, exist_ok=True)
        api().dataset_download_file(listing.ref, name, path=str(target), force=True, quiet=True)
        return str(target / name)

    return Provider(listings, fetch)


PROVIDERS: dict[str, Callable[..., Provider]] = {"kaggle": kaggle_provider, "zenodo": zenodo_provider}


def search_data_platform(term: str, platform: str = "kaggle", download_dir: str = "datasets", topn: int = 10, client: Any = None) -> list[Dataset]:
    """Search a portal, whose name is not case-sensitive, and download what is found."""
    make = PROVIDERS.get(platform.lower())
    if make is None:
        raise ValueError(f"unknown platform {platform!r}; known: {', '.join(sorted(PROVIDERS))}")
    folder = Path(download_dir)
    folder.mkdir(parents=True, exist_ok=True)
    return list(make(client).search(term, folder, topn))


class DatasetSource(DataSource):
    """``spark.read.format("dataset_search")`` with options ``term``, ``platform``, ``download_dir`` and ``topn``.

    A task downloads the files, so ``download_dir`` has to be given: an absolute folder that the driver and all executors share.
    """

    @classmethod
    def name(cls) -> str:
        return "dataset_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _DatasetReader(self.options)


class _DatasetReader(DataSourceReader):
    def __init__(self, options):
        if not Path(options.get("download_dir", "")).is_absolute():
            raise ValueError("download_dir has to be an absolute folder that the driver and all executors share")
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        options = {k: self.options[k] for k in ("platform", "download_dir") if k in self.options}
        yield from (tuple(d) for d in search_data_platform(self.options["term"], topn=int(self.options.get("topn", 10)), **options))


def catalog(spark: SparkSession, datasets: list[Dataset]) -> DataFrame:
    """Descriptors as a table."""
    return spark.createDataFrame([tuple(d) for d in datasets], SCHEMA)
