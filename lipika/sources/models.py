"""Model plug-ins: a registry of factories, called once per Python worker batch stream, with retries and pacing.

A factory returns a callable from one value to one value. Heavy imports belong inside the factory, which runs on the
executor. The names ``echo_input``, ``bytes_of_text``, ``text_of_bytes`` and ``stub_wav`` are stand-ins for tests, not models.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

Factory = Callable[[], Callable]


def _bytes_of_text():
    return lambda text: text.encode()


def _text_of_bytes():
    return lambda data: data.decode()


def _echo_input():
    """Answers a prompt with its input section."""
    return lambda text: text.split("### Input:\n", 1)[1].rsplit("\n\n### Response:", 1)[0]


_MODELS: dict[str, Factory] = {
    "echo_input": _echo_input,
    "bytes_of_text": _bytes_of_text,
    "text_of_bytes": _text_of_bytes,
    "fallback": _bytes_of_text,
    "stub_wav": _bytes_of_text,
}
#: Synthesis engines: mime type and file extension.
ENGINES: dict[str, tuple[str, str]] = {"fallback": ("audio/mpeg", "mp3"), "stub_wav": ("audio/wav", "wav")}


def register(name: str, factory: Factory, mime: str | None = None, ext: str | None = None) -> None:
    """Add a model; with ``mime`` and ``ext`` it is a synthesis engine."""
    _MODELS[name] = factory
    if mime:
        ENGINES[name] = (mime, ext or "bin")


def model_factory(name: str) -> Factory:
    if name not in _MODELS:
        raise ValueError(f"no model named {name!r}; known: {sorted(_MODELS)}")
    return _MODELS[name]


class Transient(Exception):
    """A failure worth another try: rate limits and server errors."""


def retrying(call: Callable, retries: int, wait: Callable[[int], float], retry_on=(Transient,), sleep=time.sleep) -> Callable:
    """Call again after ``wait(attempt)`` seconds, at most ``retries`` times; other errors pass at once."""

    def run(x):
        for attempt in range(retries + 1):
            try:
                return call(x)
            except retry_on:
                if attempt == retries:
                    raise
                sleep(wait(attempt))

    return run


def paced(call: Callable, seconds: float = 4.5, clock=time.monotonic, sleep=time.sleep) -> Callable:
    """At least ``seconds`` between the starts of calls; a global rate needs a single partition."""
    last = [float("-inf")]

    def run(x):
        if (gap := seconds - (clock() - last[0])) > 0:
            sleep(gap)
        last[0] = clock()
        return call(x)

    return run


def api_model(call: Callable, sleep=time.sleep) -> Callable:
    """A paced generator with up to 5 retries that wait 4.5 s, 9 s, ..."""
    return retrying(paced(call, sleep=sleep), 5, lambda k: 4.5 * (k + 1), sleep=sleep)


def speech_model(call: Callable, sleep=time.sleep) -> Callable:
    """A synthesiser with 3 attempts, 1.5 s and 3 s apart; empty audio is an error."""

    def checked(text):
        if not (audio := call(text)):
            raise ValueError("no audio")
        return audio

    return retrying(checked, 2, lambda k: 1.5 * (k + 1), retry_on=(Exception,), sleep=sleep)


def audio_of_chunks(chunks) -> bytes:
    """The audio of a chunk stream, in order; other chunk types are metadata."""
    return b"".join(c["data"] for c in chunks if c["type"] == "audio")


#: Bytes of values that a worker holds before they go out.
HELD = 4 << 20


def map_model(df: DataFrame, name: str, column: str, out: str, kind: str, by: str | None = None) -> DataFrame:
    """Add ``out``, ``{out}_error`` and ``{out}_seconds``: the model's value of each non-null cell or its error, and the time it took.

    ``by`` names a column that says which model a row goes to, ``name`` where it is null or no model; each is made once.
    Only these two columns go to the workers, and values go back in runs of about HELD bytes.
    """
    made = {n: model_factory(n) for n in ([name] if by is None else sorted(_MODELS))}
    fields = [T.StructField(out, T._parse_datatype_string(kind)), T.StructField(f"{out}_error", T.StringType()), T.StructField(f"{out}_seconds", T.DoubleType())]
    types = [to_arrow_type(f.dataType) for f in fields]
    names = ["value", "error", "seconds"]
    held_bytes = HELD

    def run(batches: Iterator[pa.Array | tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        calls: dict[str, Callable] = {}

        def model(which) -> Callable:
            which = which if which in made else name
            if which not in calls:
                calls[which] = made[which]()
            return calls[which]

        def told(rows: list[tuple]) -> pa.Array:
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.StructArray.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            cells, which = batch if by else (batch, None)
            rows, size = [], 0
            for i in range(len(cells)):
                x = cells[i].as_py()
                value = error = took = None
                if x is not None and x == x:
                    call = model(which[i].as_py() if by else name)
                    began = time.monotonic()
                    try:
                        value = call(x)
                    except Exception as e:  # a row's failure must not stop the others
                        error = f"{type(e).__name__}: {e}"
                    took = time.monotonic() - began
                    size += len(value) if isinstance(value, (bytes, str)) else 0
                rows.append((value, error, took))
                if size >= held_bytes:
                    yield told(rows)
                    rows, size = [], 0
            if rows or not len(cells):
                yield told(rows)

    # Not deterministic, so that the plan calls it once per row.
    kinds = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, fields, strict=True)])
    ask = F.arrow_udf(run, kinds, F.ArrowUDFType.SCALAR_ITER).asNondeterministic()
    # Always true, but the planner must not move a column's expression into the call, where it is not evaluated if it has lambdas.
    now = F.monotonically_increasing_id() >= 0
    wanted = {"_cell": F.when(now, df[f"`{column}`"])} | ({} if by is None else {"_by": F.when(now, df[f"`{by}`"])})
    asked = df.withColumns(wanted).withColumn("_told", ask(*wanted)).drop(*wanted)
    return asked.withColumns({f.name: F.col(f"_told.{n}") for n, f in zip(names, fields, strict=True)}).drop("_told")


def latency(df: DataFrame, out: str) -> DataFrame:
    """Calls, failures, and the mean and the longest time of a mapped model."""
    s = F.nanvl(f"{out}_seconds", F.lit(None).cast("double"))
    return df.agg(F.count(s).alias("calls"), F.count(f"{out}_error").alias("errors"), F.avg(s).alias("mean_seconds"), F.max(s).alias("max_seconds"))
