"""Services as Spark data sources: pages, a chain of feeds, rows until a short page, searches that take filters, members of archives.

Addresses are ``http(s)://`` or ``file://`` ones. What is read is fetched by the task that needs it; to plan, the driver
looks at the heads of a chain's feeds, at some pages' sizes, or at an archive's directory.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import urllib.error
import urllib.parse
import urllib.request
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from datetime import date, timedelta
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringStartsWith,
)

from bidlens.session import prepare

#: Rows of a page and rows in all that the EU service gives; pages of a chain; days that increments overlap.
EU_PAGE, EU_MOST, CHAIN_MOST, OVERLAP = 250, 15_000, 60, 3


def fetch(address: str, posted: str | None = None) -> str | None:
    """The text at an address, asked by POST with a JSON body if one is given; null where there is nothing."""
    asked = urllib.request.Request(address, posted.encode() if posted is not None else None, {"Content-Type": "application/json"} if posted is not None else {})
    try:
        with urllib.request.urlopen(asked, timeout=60) as answer:  # noqa: S310
            return answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        if e.code == 404:
            return None
        raise
    except urllib.error.URLError as e:
        if isinstance(e.reason, FileNotFoundError):
            return None
        raise


def _local(address: str) -> Path | None:
    return Path(urllib.parse.unquote(urllib.parse.urlparse(address).path)) if address.startswith("file:") else None


def length(address: str) -> int:
    if local := _local(address):
        return local.stat().st_size
    with urllib.request.urlopen(urllib.request.Request(address, method="HEAD"), timeout=60) as answer:  # noqa: S310
        return int(answer.headers["Content-Length"])


def fetch_range(address: str, start: int, stop: int) -> bytes:
    """The bytes from ``start`` up to ``stop``; a server that doesn't give just these is refused."""
    if local := _local(address):
        with local.open("rb") as f:
            f.seek(start)
            return f.read(stop - start)
    with urllib.request.urlopen(urllib.request.Request(address, headers={"Range": f"bytes={start}-{stop - 1}"}), timeout=60) as answer:  # noqa: S310
        if answer.status != 206:
            raise ValueError(f"{address}: no ranges")
        return answer.read()


def page_count(total: int, size: int = EU_PAGE, most: int = EU_MOST) -> int:
    """Pages that hold ``total`` rows, or what the service gives of them."""
    return -(-min(total, most) // size)


def increment_since(cursor: str | None, today: date, window: int = 30, overlap: int = OVERLAP) -> date:
    """Where an increment begins: some days before the cursor, or a window before today where there is none that can be read."""
    try:
        return date.fromisoformat(cursor or "") - timedelta(days=overlap)
    except ValueError:
        return today - timedelta(days=window)


class Page(InputPartition):
    def __init__(self, number: int, address: str) -> None:
        super().__init__(number)
        self.number, self.address = number, address


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.template, self.first, self.count = options["path"], int(options.get("first", "1")), int(options["pages"])

    def partitions(self) -> list[Page]:
        return [Page(k, self.template.replace("{page}", str(k))) for k in range(self.first, self.first + self.count)]

    def read(self, partition: Page) -> Iterator[tuple]:
        body = fetch(partition.address)
        if body is not None:
            yield partition.number, body


class PageSource(DataSource):
    """page and body. ``path`` has ``{page}`` where the number goes; ``pages`` and ``first`` tell which; a missing page is no row."""

    @classmethod
    def name(cls) -> str:
        return "notice_pages"

    def schema(self) -> str:
        return "page int, body string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


def head(body: str) -> tuple[str | None, str | None]:
    """When a feed was updated, and the address of the next one."""
    top = body.split("<entry", 1)[0]
    updated = re.search(r"<updated>\s*([^<\s]+)", top)
    links = [x for x in re.findall(r"<link\b[^>]*>", body) if re.search(r"""rel=["']next["']""", x)]
    following = re.search(r"""href=["']([^"']+)""", links[0]) if links else None
    return updated and updated[1], following and following[1].replace("&amp;", "&")


class ChainReader(DataSourceStreamReader):
    """A walk along the chain takes as many batches as it needs. Between them the offset holds the place: ``at`` is the feed to go
    on with, ``walked`` tells the feeds that the walk has met, ``newest`` is what the cursor becomes at its end."""

    def __init__(self, options: dict[str, str]) -> None:
        self.address, self.since = options["path"], options.get("since", "")
        self.most, self.first = int(options.get("most", str(CHAIN_MOST))), int(options.get("first", "1"))
        self.reached: dict | None = None

    def initialOffset(self) -> dict:
        return {"cursor": self.since, "at": "", "newest": "", "walked": "", "feeds": ""}

    def latestOffset(self) -> dict:
        if self.reached is None:
            self.reached = self.initialOffset()
        self.reached = self.walk(self.reached)
        return self.reached

    def walk(self, start: dict) -> dict:
        """The offset after up to ``most`` more feeds, which it lists."""
        cursor, at, newest = start["cursor"], start["at"] or self.address, start["newest"]
        walked, feeds = set(start["walked"].split()), []
        while at and (mark := hashlib.sha256(at.encode()).hexdigest()[:16]) not in walked:
            if len(feeds) == self.most:
                return {"cursor": cursor, "at": at, "newest": newest, "walked": " ".join(sorted(walked)), "feeds": "\n".join(feeds)}
            body = fetch(at)
            if body is None:
                break
            updated, following = head(body)
            if not walked:
                if updated and updated == cursor:
                    return start  # nothing has come since
                newest = updated or cursor
            walked.add(mark)
            feeds.append(at)
            if (cursor and updated and updated <= cursor) or (not cursor and len(walked) >= self.first):
                break
            at = following
        return {"cursor": newest or cursor, "at": "", "newest": "", "walked": "", "feeds": "\n".join(feeds)} if feeds or start["at"] else start

    def partitions(self, start: dict, end: dict) -> list[Page]:
        if self.reached is None:  # after a restart Spark plans the last batch again
            self.reached = end
        return [Page(k, at) for k, at in enumerate(end["feeds"].split("\n")) if at]

    def read(self, partition: Page) -> Iterator[tuple]:
        body = fetch(partition.address)
        if body is not None:
            yield partition.address, head(body)[0], body


class ChainSource(DataSource):
    """address, updated and body of feeds from ``path`` along ``rel="next"``, until one is not newer than the cursor.

    A batch takes ``most`` feeds at most; the next one, also of a later run on the same checkpoint, goes on where it ended, so no
    feed is left out. A chain that comes back to a feed ends there. Without a cursor (option ``since``, or the offset in
    the checkpoint) it ends after ``first`` feeds. The cursor moves when the walk is done; a new checkpoint folder sets it back.
    """

    @classmethod
    def name(cls) -> str:
        return "notice_chain"

    def schema(self) -> str:
        return "address string, updated string, body string"

    def streamReader(self, schema) -> ChainReader:
        return ChainReader(self.options)


# Rows by page until a short one


def rows_of(body: str | None, key: str) -> list:
    """The rows of a page: the JSON list itself, or the one under ``key``."""
    found = json.loads(body) if body else []
    return (found.get(key) or []) if key else found


class Slice(InputPartition):
    def __init__(self, page: int, address: str, body: str | None, first: int, last: int) -> None:
        super().__init__(page)
        self.page, self.address, self.body, self.first, self.last = page, address, body, first, last


class RowsReader(DataSourceStreamReader):
    """The offset is (cursor, row): rows before it have been read. The last page is sought by doubling, then halving the step, so the driver looks at few."""

    def __init__(self, options: dict[str, str]) -> None:
        self.template, self.posted, self.key = options["path"], options.get("body"), options.get("rows", "")
        self.size, self.most, self.since = int(options["size"]), int(options.get("most", "1000")), options.get("since", "")
        self.reached: dict | None = None

    def initialOffset(self) -> dict:
        return {"cursor": self.since, "row": 0}

    def asked(self, page: int, cursor: str) -> tuple[str, str | None]:
        values = {"page": page + 1, "offset": page * self.size, "limit": self.size, "since": cursor}
        filled = lambda t: re.sub(r"\{(page|offset|limit|since)\}", lambda m: str(values[m[1]]), t)
        return filled(self.template), filled(self.posted) if self.posted else None

    def held(self, page: int, cursor: str) -> int:
        return len(rows_of(fetch(*self.asked(page, cursor)), self.key))

    def latestOffset(self) -> dict:
        if self.reached is None:
            self.reached = self.initialOffset()
        cursor, row = self.reached["cursor"], self.reached["row"]
        low = row // self.size
        limit, step, n = low + self.most, 1, self.held(low, cursor)
        full = low if n >= self.size else None
        if full is not None:  # a page that is full, then the first that isn't
            high, n = full + 1, 0
            while high < limit and (n := self.held(high, cursor)) >= self.size:
                full, step = high, step * 2
                high = min(limit, high + step)
            while high - full > 1:
                middle = (full + high) // 2
                if (found := self.held(middle, cursor)) >= self.size:
                    full = middle
                else:
                    high, n = middle, found
            low, n = (high, n) if high < limit else (full, self.size)
        self.reached = {"cursor": cursor, "row": max(row, low * self.size + n)}
        return self.reached

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        if self.reached is None:
            self.reached = end
        size, first, last = self.size, start["row"], end["row"]
        return [Slice(p, *self.asked(p, end["cursor"]), max(first - p * size, 0), min(last - p * size, size)) for p in range(first // size, -(-last // size))]

    def read(self, partition: Slice) -> Iterator[tuple]:
        for row in rows_of(fetch(partition.address, partition.body), self.key)[partition.first : partition.last]:
            yield partition.page + 1, json.dumps(row, ensure_ascii=False)


class RowsSource(DataSource):
    """page and row (as JSON) of a service that gives ``size`` rows a page; the first page with fewer is the last.

    ``path`` and, for a service that is asked by POST, ``body`` have ``{offset}``, ``{page}`` (from 1), ``{limit}`` and
    ``{since}``; ``rows`` names the list in the answer. A batch takes ``most`` pages at most. What is appended later
    comes with the next batch, the rows that the last page had before being left out.
    """

    @classmethod
    def name(cls) -> str:
        return "notice_rows"

    def schema(self) -> str:
        return "page int, row string"

    def streamReader(self, schema) -> RowsReader:
        return RowsReader(self.options)


# Filters that the service evaluates


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def regional_where(cpv: Sequence[str] = (), terms: Sequence[str] = (), since: str | None = None, texts: Sequence[str] = ("objecte_contracte", "denominacio", "descripcio_lot")) -> str:
    """The regional service's words for: any of the codes begins so or any of the texts has any of the terms, and published since a day."""
    either = [f"starts_with(codi_cpv, {quoted(c)})" for c in cpv] + [f"contains(upper({t}), {quoted(x.upper())})" for x in terms for t in texts]
    return " and ".join(x for x in (f"({' or '.join(either)})" if either else "", f"data_publicacio_anunci >= {quoted(since + 'T00:00:00')}" if since else "") if x)


class RegionalReader(DataSourceReader):
    """Rows of the regional service. The number of pages is asked for with the conditions that narrow them."""

    def __init__(self, options: dict[str, str], fields: list[str]) -> None:
        self.address, self.size, self.fields = options["path"], int(options.get("size", "1000")), fields
        self.where = [f"({options['where']})"] if options.get("where") else []

    def clause(self, f: Filter) -> str | None:
        """The filter in the service's terms, if it has a way to say it. Order is that of ISO dates, so only dates are compared."""
        column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
        if column not in self.fields:
            return None
        dated = column.startswith("data_")
        match f:
            case EqualTo(value=str(v)):
                return f"{column} = {quoted(v)}"
            case In(value=vs) if all(isinstance(v, str) for v in vs):
                return f"{column} in ({', '.join(map(quoted, vs))})"
            case GreaterThanOrEqual(value=str(v)) if dated:
                return f"{column} >= {quoted(v)}"
            case GreaterThan(value=str(v)) if dated:
                return f"{column} > {quoted(v)}"
            case LessThanOrEqual(value=str(v)) if dated:
                return f"{column} <= {quoted(v)}"
            case LessThan(value=str(v)) if dated:
                return f"{column} < {quoted(v)}"
            case StringStartsWith(value=str(v)):
                return f"starts_with({column}, {quoted(v)})"
            case StringContains(value=str(v)):
                return f"contains({column}, {quoted(v)})"
            case IsNotNull():
                return f"{column} is not null"
        return None

    def asked(self, **more: str | int) -> str:
        where = {"$where": " and ".join(self.where)} if self.where else {}
        return f"{self.address}?{urllib.parse.urlencode({**where, **{f'${k}': v for k, v in more.items()}})}"

    def partitions(self) -> list[Page]:
        (row,) = rows_of(fetch(self.asked(select="count(*) as n")), "")
        return [Page(k, self.asked(limit=self.size, offset=k * self.size, order=":id")) for k in range(-(-int(row["n"]) // self.size))]

    def read(self, partition: Page) -> Iterator[tuple]:
        as_text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        for row in rows_of(fetch(partition.address), ""):
            yield tuple(as_text(row.get(f)) for f in self.fields)


class PushedRegionalReader(RegionalReader):
    """Filters on the service's columns go into ``$where``, as far as it has a way to say them; the rest is left to Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if said := self.clause(f):
                self.where.append(said)
            else:
                yield f


class RegionalSource(DataSource):
    """The fields given by ``fields`` (separated by spaces), all text, of the rows that the service finds for ``where`` (as :func:`regional_where` writes it); objects as JSON. One partition a page of ``size`` rows."""

    @classmethod
    def name(cls) -> str:
        return "regional_service"

    def schema(self) -> str:
        return ", ".join(f"{f} string" for f in self.options["fields"].split())

    def reader(self, schema) -> RegionalReader:
        kind = PushedRegionalReader if self.options.get("push") == "true" else RegionalReader
        return kind(self.options, self.options["fields"].split())


def eu_query(country: str = "ESP", since: str | None = None, cpv: Sequence[str] = (), terms: Sequence[str] = ()) -> str:
    """A search in the EU service's language: the country, a first day, and any of the codes or terms. Quotes in terms are escaped."""
    term = lambda t: t.replace("\\", r"\\").replace('"', r"\"")
    either = [f"(classification-cpv IN ({' '.join(cpv)}))"] if cpv else []
    either += ["(" + " OR ".join(f'FT~"{term(t)}"' for t in terms) + ")"] if terms else []
    day = [f"(publication-date>={since.replace('-', '')})"] if since else []
    return " AND ".join([f"(buyer-country={country})", *day, *([f"({' OR '.join(either)})"] if either else [])])


class SearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.address, self.size, self.most = options["path"], int(options.get("size", str(EU_PAGE))), int(options.get("most", str(EU_MOST)))
        self.fields = options.get("fields", "publication-number publication-date").split()
        listed = lambda name: [x for x in options.get(name, "").split("|") if x]
        self.query = eu_query(options.get("country", "ESP"), options.get("since"), listed("cpv"), listed("terms"))

    def asked(self, page: int) -> str:
        return json.dumps({"query": self.query, "fields": self.fields, "limit": self.size, "page": page, "onlyLatestVersions": True})

    def partitions(self) -> list[Slice]:
        total = json.loads(fetch(self.address, self.asked(1)) or "{}").get("totalNoticeCount", 0)
        if total > self.most:
            raise ValueError(f"the service finds {total} notices and gives {self.most}: ask for fewer days or terms")
        return [Slice(k, self.address, self.asked(k), 0, self.size) for k in range(1, page_count(total, self.size, self.most) + 1)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        for n in rows_of(fetch(partition.address, partition.body), "notices"):
            yield n.get("publication-number"), (n.get("publication-date") or "")[:10] or None, json.dumps({"notices": [n]}, ensure_ascii=False)


class PushedSearchReader(SearchReader):
    """A lower bound on ``published`` and an equal ``number`` become part of the query; everything else is left to Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            match f:
                case GreaterThanOrEqual(attribute=("published",), value=str(v)) if re.fullmatch(r"\d{4}-\d{2}-\d{2}", v):
                    self.query += f" AND (publication-date>={v.replace('-', '')})"
                case EqualTo(attribute=("number",), value=str(v)) if re.fullmatch(r"[\w-]+", v):
                    self.query += f" AND (publication-number={v})"
                case _:
                    yield f


class SearchSource(DataSource):
    """number, published (a day) and body (a page of one notice) of what the EU service finds for ``terms`` and ``cpv`` (each separated by ``|``), ``country`` and ``since``.

    It is asked by POST, a partition a page. More notices than it gives in all are an error, not a silent cut.
    """

    @classmethod
    def name(cls) -> str:
        return "eu_search"

    def schema(self) -> str:
        return "number string, published string, body string"

    def reader(self, schema) -> SearchReader:
        return (PushedSearchReader if self.options.get("push") == "true" else SearchReader)(self.options)


# Members of archives


class RangeFile(io.RawIOBase):
    """A file at an address, of which only the ranges that are read are fetched."""

    def __init__(self, address: str) -> None:
        self.address, self.at, self.size = address, 0, length(address)

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.size}[whence]
        return self.at

    def tell(self) -> int:
        return self.at

    def read(self, n: int = -1) -> bytes:
        stop = self.size if n is None or n < 0 else min(self.size, self.at + n)
        out = fetch_range(self.address, self.at, stop) if stop > self.at else b""
        self.at += len(out)
        return out


class Member(InputPartition):
    def __init__(self, archive: str, info: zipfile.ZipInfo) -> None:
        super().__init__(info.filename)
        self.archive, self.name, self.offset, self.size, self.method = archive, info.filename, info.header_offset, info.compress_size, info.compress_type


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.suffix, self.piece = options["path"], options.get("suffix", ".atom"), int(options.get("piece", str(1 << 20)))

    def partitions(self) -> list[Member]:
        """From the archives' directories, which lie at their ends; nothing else of them is read here."""
        local = _local(self.path)
        archives = sorted(x.as_uri() for x in local.glob("*.zip")) if local and local.is_dir() else self.path.split()
        out = []
        for a in archives:
            with zipfile.ZipFile(RangeFile(a)) as z:
                out += [Member(a, i) for i in z.infolist() if i.filename.endswith(self.suffix) and not i.is_dir()]
        return out

    def read(self, m: Member) -> Iterator[tuple]:
        """One member, inflated as its bytes come in."""
        fixed = fetch_range(m.archive, m.offset, m.offset + 30)
        at = m.offset + 30 + int.from_bytes(fixed[26:28], "little") + int.from_bytes(fixed[28:30], "little")
        if fixed[:4] != b"PK\x03\x04" or m.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise ValueError(f"{m.archive}: {m.name} can't be read")
        inflate = zlib.decompressobj(-15) if m.method == zipfile.ZIP_DEFLATED else None
        out = io.BytesIO()
        for k in range(at, at + m.size, self.piece):
            raw = fetch_range(m.archive, k, min(k + self.piece, at + m.size))
            out.write(inflate.decompress(raw) if inflate else raw)
        out.write(inflate.flush() if inflate else b"")
        yield m.archive, m.name, out.getvalue().decode("utf-8", "replace")


class ArchiveSource(DataSource):
    """archive, member and body of the members of ZIP archives whose names end in ``suffix``; one partition a member.

    ``path`` is a folder (``file://``), or addresses of archives separated by spaces. A task fetches its member's bytes
    alone, so an archive may be of any size; one that isn't a ZIP is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "notice_archive"

    def schema(self) -> str:
        return "archive string, member string, body string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def register(spark: SparkSession) -> SparkSession:
    """The sources by name. Filters reach a search that is loaded with the option ``push``.

    Spark 4.1 keeps what one scan of a loaded frame has pushed for other scans of that frame, so a frame that is loaded with
    ``push`` may stand once in one query; load it anew for another. Without it Spark filters by itself, and a search is
    narrowed by the source's options alone.
    """
    prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (PageSource, ChainSource, RowsSource, RegionalSource, SearchSource, ArchiveSource):
        spark.dataSource.register(source)
    return spark
