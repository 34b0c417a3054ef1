"""Explicit schemas of the document formats, as DDL; readers never infer."""

_SEGMENTS = "array<struct<hash:string,length:bigint>>"

# One document per genome, as exchanged with other tools.
MANIFEST = (
    "version int, graph_version int, organism string, assembly string, total_bases bigint, "
    "encoding string, chunking struct<algorithm:string,min_size:bigint,max_size:bigint>, "
    "created_at timestamp, segments_root string, "
    f"chromosomes array<struct<name:string,length:bigint,hash:string,segments:{_SEGMENTS}>>"
)

RECIPE = (
    "assembly string, reference string, total_size bigint, "
    "chunks array<struct<hash:string,length:bigint>>"
)

# Sketch hashes are unsigned 64-bit numbers.
SKETCH = "assembly string, kmer int, size int, hashes array<decimal(20,0)>"

ACTIVITY = (
    "op string, assembly string, bytes bigint, segments bigint, note string, time timestamp"
)

ANNOUNCE = (
    "node_id string, address string, kind string, hashes array<string>, ts bigint, sig string"
)

DELTA_OPS = (
    "assembly string, reference string, reference_hash string, chrom_idx bigint, chrom string, "
    "length bigint, hash string, op_idx bigint, type string, ref_chrom string, "
    "ref_start bigint, ref_end bigint, bytes binary"
)
