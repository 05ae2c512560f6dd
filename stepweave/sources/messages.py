"""Messages of a recording as streams of samples, and readers of recording files that need packages of their own."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IngestError, need
from ..functions.keys import topic_name

#: Fixed value: nanoseconds between the steps of recordings that have no times of their own.
STEP_NS = 20_000_000


def project(messages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., stream, values) from messages (topic, schema, position, velocity, data, linear, angular).

    Joint states give joint_pos, and joint_vel if there are velocities; arrays their topic; twists the six numbers linear and angular. Others go.
    """
    name = topic_name(F.col("topic"))
    twist = F.array(*[F.col(f"{a}.{b}") for a in ("linear", "angular") for b in "xyz"])
    parts = F.array(
        F.when(F.col("schema") == "JointState", F.struct(F.lit("joint_pos").alias("stream"), F.col("position").alias("values"))),
        F.when((F.col("schema") == "JointState") & (F.size("velocity") > 0), F.struct(F.lit("joint_vel").alias("stream"), F.col("velocity").alias("values"))),
        F.when(F.col("schema") == "Float64MultiArray", F.struct(name.alias("stream"), F.col("data").alias("values"))),
        F.when(F.col("schema") == "Twist", F.struct(name.alias("stream"), twist.alias("values"))),
    )
    out = messages.select(*keep, F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("_p"))
    return out.select(*keep, "_p.stream", "_p.values")


def sampled(topic: str, schema: str, message: object) -> list[tuple[str, list[float]]]:
    """(stream, values) of one decoded message; what project() does for a table of them."""
    name = re.sub(r"^/+", "", topic).replace("/", "_")
    if schema == "JointState":
        own = [("joint_pos", message.position), *([("joint_vel", message.velocity)] if len(message.velocity) else [])]
    elif schema == "Float64MultiArray":
        own = [(name, message.data)]
    elif schema == "Twist":
        own = [(name, [getattr(getattr(message, part), axis) for part in ("linear", "angular") for axis in "xyz"])]
    else:
        own = []
    return [(stream, [float(x) for x in values]) for stream, values in own]


def read_mcap(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """(recording_id, stream, t_ns, values) of the files in paths (path); needs the package mcap_ros2 on the executors.

    One task reads one file. A message that cannot be decoded is skipped, the next is read; of a file cut short what is there is read. Both
    are warned of, with their number.
    """
    need("mcap_ros2", "reading MCAP files")

    def read(batches: Iterator) -> Iterator:
        import pandas as pd
        from mcap.reader import make_reader
        from mcap_ros2.decoder import DecoderFactory

        for batch in batches:
            for path in batch["path"]:
                rows, bad, decoders = [], 0, {}
                with open(path.removeprefix("file:"), "rb") as f:
                    stream = make_reader(f).iter_messages()
                    while True:
                        try:
                            schema, channel, m = next(stream)
                        except StopIteration:
                            break
                        except Exception as e:  # noqa: BLE001  cut short: what was read so far stays
                            warnings.warn(f"{path} ends early: {e}", stacklevel=1)
                            break
                        try:
                            if schema.id not in decoders:
                                decoders[schema.id] = DecoderFactory().decoder_for(channel.message_encoding, schema)
                            own = sampled(channel.topic, schema.name.rsplit("/", 1)[-1], decoders[schema.id](m.data))
                        except Exception:  # noqa: BLE001  one message
                            bad += 1
                            continue
                        rows += [(path, s, m.log_time, v) for s, v in own]
                if bad:
                    warnings.warn(f"{path}: {bad} messages cannot be decoded and are skipped", stacklevel=1)
                yield pd.DataFrame(rows, columns=["recording_id", "stream", "t_ns", "values"])

    n = max(1, paths.count())
    return paths.select("path").repartition(n).mapInPandas(read, "recording_id string, stream string, t_ns bigint, values array<double>")


def read_hdf5(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """(path, demo, step, t_ns, action, obs) of files with /data/demo_N; needs the package h5py on the executors.

    Numbers of one or two dimensions are observations; images are not read. Times are made up, STEP_NS apart. A file without /data, or a demo without actions or obs, raises.
    """
    need("h5py", "reading HDF5 files")

    def read(batches: Iterator) -> Iterator:
        import h5py
        import pandas as pd

        for batch in batches:
            for path in batch["path"]:
                with h5py.File(path.removeprefix("file:"), "r") as f:
                    if "data" not in f:
                        raise IngestError(f"{path} has no group data")
                    for demo in sorted((k for k in f["data"] if k.startswith("demo_")), key=lambda k: int(k.split("_")[1])):
                        own = f["data"][demo]
                        if "actions" not in own or "obs" not in own:
                            raise IngestError(f"{path}, {demo} needs actions and obs")
                        acts = own["actions"][:].astype(float)
                        obs = {k: (v[:].astype(float).reshape(len(v), 1) if v.ndim == 1 else v[:].astype(float)) for k, v in own["obs"].items() if v.ndim in (1, 2)}
                        yield pd.DataFrame([(path, int(demo.split("_")[1]), i, i * STEP_NS, list(a), {k: list(v[i]) for k, v in obs.items()}) for i, a in enumerate(acts)], columns=["path", "demo", "step", "t_ns", "action", "obs"])

    n = max(1, paths.count())
    return paths.select("path").repartition(n).mapInPandas(read, "path string, demo int, step int, t_ns bigint, action array<double>, obs map<string,array<double>>")
