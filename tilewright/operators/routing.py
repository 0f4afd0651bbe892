"""Which backend, route and stages a request takes, as metadata of the plan; all work itself runs in Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of the encode stages, in the order in which a missing one is reported.
STAGES = {"forward_rct": 1, "forward_dwt53": 2, "tier1_code_block": 4, "ht_code_block": 8, "packetization": 16}
#: Output formats that an explicit device request may have.
JPEG_DEVICE_FORMATS = ("Gray8", "Rgb8", "Rgba8")
J2K_DEVICE_FORMATS = ("Gray8", "Rgb8", "Rgba8", "Gray16", "Rgb16")
#: Codestream markers after which a header is read again by the full engine.
RETRY_MARKERS = (0x50, 0x53, 0x55, 0x57, 0x58, 0x59, 0x5C, 0x5D, 0x5E, 0x5F, 0x60, 0x61, 0x63, 0x64, 0x91, 0x92)


def supports(request: Column, metal: Column, cuda: Column) -> Column:
    return F.when(request == "Metal", metal).when(request == "Cuda", cuda).otherwise(request.isin("Auto", "Cpu"))


def resolve(request: Column, metal: Column, cuda: Column) -> Column:
    """The backend a request gets; null for one that isn't there."""
    best = F.when(metal, "Metal").when(cuda, "Cuda").otherwise("Cpu")
    return F.when(request == "Auto", best).when(supports(request, metal, cuda), request)


def _route(request: Column, refused: Column, available: Column) -> Column:
    device = F.when(refused, "RejectExplicitMetal").when(available, "MetalKernel").otherwise("MetalUnavailable")
    return F.when(request.isin("Cpu", "Auto"), "CpuHost").when(request == "Metal", device).otherwise("RejectUnsupportedBackend")


def jpeg_route(request: Column, fast_packet: Column, fmt: Column, available: Column) -> Column:
    return _route(request, ~fast_packet | ~fmt.isin(*JPEG_DEVICE_FORMATS), available)


def jpeg_reject_reason(request: Column, fast_packet: Column, fmt: Column) -> Column:
    return F.when(request == "Metal", F.when(~fast_packet, "no_fast_packet").when(~fmt.isin(*JPEG_DEVICE_FORMATS), "output_format"))


def j2k_route(request: Column, fmt: Column, available: Column) -> Column:
    return _route(request, ~fmt.isin(*J2K_DEVICE_FORMATS), available)


def supported_format(fmt: Column) -> Column:
    return fmt != "Rgba16"


def required_stages(components: Column, reversible: Column, levels: Column, high_throughput: Column) -> Column:
    """Bits of the stages that a lossless encode needs."""
    bit = lambda cond, name: F.when(cond, STAGES[name]).otherwise(0)
    parts = [bit((components >= 3) & reversible, "forward_rct"), bit(levels > 0, "forward_dwt53"), bit(~high_throughput, "tier1_code_block"), bit(high_throughput, "ht_code_block")]
    return sum(parts, F.lit(STAGES["packetization"]))


def missing_stage(required: Column, dispatch: dict[str, Column]) -> Column:
    """The first stage that is needed and was never dispatched."""
    return F.coalesce(*[F.when((required.bitwiseAND(F.lit(bit)) != 0) & (dispatch[name] == 0), name) for name, bit in STAGES.items()])


def delta(after: Column, before: Column) -> Column:
    return F.greatest(after - before, F.lit(0))


def keeps_device_result(requested: Column, wanted: Column, got: Column, dispatched: Column) -> Column:
    """Whether an encode stays with its accelerator: it ran there, or in part under Auto."""
    return (got == wanted) | ((requested == "Auto") & (dispatched > 0))


def checkpoints(mcus: Column, restart: Column, cadence: Column) -> Column:
    """Places from which a scan can be entered: one per restart interval, else per cadence."""
    every = F.when(restart > 0, restart).otherwise(F.greatest(cadence, F.lit(1)))
    return 1 + F.floor(F.greatest(mcus - 1, F.lit(0)) / every)


def scan_payload(scan: Column, restarts: Column) -> Column:
    """(n_bytes, missing_eoi, error, at) of entropy-coded bytes up to and with the end marker.

    Stuffed zeros, and restart markers where they are allowed, belong to the data. Any other marker
    is an error at its place; a scan without an end, or with a lone last 0xFF, is taken whole.
    """
    text = F.decode(scan, "ISO-8859-1")
    mark = F.when(restarts, F.regexp_instr(text, F.lit("ÿ(?![\\x00\\u00d0-\\u00d7])"))).otherwise(F.regexp_instr(text, F.lit("ÿ(?!\\x00)")))
    n = F.octet_length(scan)
    found = F.ascii(F.substring(text, mark + 1, F.lit(1)))
    open_ = (mark == 0) | (mark == n)
    good = open_ | (found == 0xD9)
    return F.struct(F.when(good, F.when(open_, n).otherwise(mark + 1)).cast("long").alias("n_bytes"), F.when(good, open_).alias("missing_eoi"), F.when(~good, "unexpected_marker").alias("error"), F.when(~good, mark - 1).cast("long").alias("at"))


def retries(marker: Column) -> Column:
    return marker.isin(*RETRY_MARKERS)
