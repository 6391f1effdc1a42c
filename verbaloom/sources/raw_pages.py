"""Folders of raw pages, and one file a language, as Spark data sources.

`rawpages` reads a folder of files `<page_id>.page` (the url in the first line, then the page), a partition for each
group of files; a filter on page_id drops files before they are opened, and a file that can't be read is a row with
an error. `languagefiles` writes texts, or tokens as a JSON array, into one file a language. Both write to a staging
folder and move what successful tasks report when the job commits, so a task that fails or runs twice leaves
nothing behind. Paths are those of pyarrow's file systems: a mounted folder, file://, hdfs:// or s3://."""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

#: Files of a partition.
FILES = 256


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Files(InputPartition):
    names: list[str]


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has finished: (staged path, name)."""

    files: list[tuple[str, str]]


class PageReader(DataSourceReader):
    def __init__(self, path: str, files: int):
        self.path, self.files, self.ids = path, files, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("page_id",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.ids = own if self.ids is None else self.ids & own
            else:
                yield f

    def partitions(self) -> list[Files]:
        system, root = opened(self.path)
        names = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(root)) if i.is_file and i.base_name.endswith(".page"))
        if self.ids is not None:
            wanted = {f"{i}.page" for i in self.ids}
            names = [n for n in names if n in wanted]
        return [Files(names[i : i + self.files]) for i in range(0, len(names), self.files)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, root = opened(self.path)
        for name in partition.names:
            try:
                page = int(name.removesuffix(".page"))
                with system.open_input_stream(f"{root}/{name}") as f:
                    url, end, html = f.read().decode().partition("\n")
                if not end:
                    raise ValueError("no line with a url")
                yield page, url or None, html, name, None
            except (ValueError, OSError) as e:
                yield None, None, None, name, f"{type(e).__name__}: {e}"


class StagedWriter(DataSourceWriter):
    """Files of tasks in a staging folder; moved in when all tasks are through."""

    def __init__(self, path: str):
        self.path, self.staging = path, f"_staging-{uuid.uuid4().hex}"

    def stage(self) -> tuple[fs.FileSystem, str]:
        """A folder of this attempt's own."""
        system, root = opened(self.path)
        own = f"{root}/{self.staging}/{uuid.uuid4().hex}"
        system.create_dir(own, recursive=True)
        return system, own

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        found = [f for m in messages if m for f in m.files]
        names = [name for _, name in found]
        try:
            if twice := sorted(n for n, k in Counter(names).items() if k > 1):
                raise ValueError(f"several tasks wrote {', '.join(twice[:5])}: put a file's rows into one partition")
            for staged, name in found:
                system.move(staged, f"{root}/{name}")
        finally:
            self.clear()

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()

    def clear(self) -> None:
        system, root = opened(self.path)
        if system.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.staging}")


class PageWriter(StagedWriter):
    def write(self, rows: Iterator) -> Written:
        system, own = self.stage()
        files = []
        for r in rows:
            name = f"{r['page_id']}.page"
            with system.open_output_stream(f"{own}/{name}") as f:
                f.write(f"{r['url'] or ''}\n{r['html'] or ''}".encode())
            files.append((f"{own}/{name}", name))
        return Written(files)


class RawPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawpages"

    def schema(self) -> str:
        return "page_id long, url string, html string, file string, error string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["path"], int(self.options.get("files", FILES)))

    def writer(self, schema, overwrite: bool) -> PageWriter:
        return PageWriter(self.options["path"])


class LanguageWriter(StagedWriter):
    """Rows (lang, value) in order: texts one after the other, or values as one JSON array."""

    def __init__(self, path: str, kind: str):
        super().__init__(path)
        self.kind = kind

    def write(self, rows: Iterator) -> Written:
        system, own = self.stage()
        files: dict[str, tuple] = {}
        try:
            for lang, value in rows:
                name = f"{quote(lang if lang is not None else 'und', safe='')}.{self.kind}"
                if name not in files:
                    files[name] = (system.open_output_stream(f"{own}/{name}"), [0])
                f, n = files[name]
                if self.kind == "json":
                    f.write((("[" if n[0] == 0 else ", ") + json.dumps(value, ensure_ascii=False)).encode())
                elif value is not None:
                    f.write(value.encode())
                n[0] += 1
            for f, _ in files.values():
                f.write(b"]" if self.kind == "json" else b"")
        finally:
            for f, _ in files.values():
                f.close()
        return Written([(f"{own}/{name}", name) for name in files])


class LanguageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "languagefiles"

    def writer(self, schema, overwrite: bool) -> LanguageWriter:
        return LanguageWriter(self.options["path"], self.options.get("kind", "txt"))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawPages)
    spark.dataSource.register(LanguageFiles)


def read_pages(spark: SparkSession, path: str, files: int = FILES) -> DataFrame:
    register(spark)
    return spark.read.format("rawpages").option("files", files).load(path)


def write_pages(pages: DataFrame, path: str) -> None:
    register(pages.sparkSession)
    pages.select("page_id", "url", "html").write.format("rawpages").mode("append").save(path)


def write_language_files(rows: DataFrame, path: str, *order: str, kind: str = "txt") -> None:
    """rows (lang, value, and what orders them) as <lang>.<kind>. A file is written by one task, which holds a row at a
    time; a language that is too large for one file should stay a table."""
    register(rows.sparkSession)
    dealt = rows.repartition("lang").sortWithinPartitions("lang", *order)
    dealt.select("lang", "value").write.format("languagefiles").option("kind", kind).mode("append").save(path)
