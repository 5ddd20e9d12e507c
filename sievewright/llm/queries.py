"""The registered queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, fim, fingerprint, langid, lattice, linedup, minhash, mixing, packing, quality, secrets, vafile, warc

QUERIES = {
    "op1_quality": quality.query,
    "op2_minhash": minhash.query,
    "op3_langid": langid.query,
    "op4_warc": warc.query,
    "op5_lattice": lattice.query,
    "op6_linedup": linedup.query,
    "op7_packing": packing.query,
    "op8_mixing": mixing.query,
    "op9_fingerprint": fingerprint.query,
    "op10_secrets": secrets.query,
    "op11_vafile": vafile.query,
    "op12_bpe": bpe.query,
    "op13_fim": fim.query,
}

ORACLES = {
    "op4_warc": warc.SQL,
    "op8_mixing": mixing.SQL,
    "op10_secrets": secrets.SQL,
    "op11_vafile": vafile.SQL,
    "op13_fim": fim.SQL,
}
