from pyspark.sql import functions as F

from marlstone.functions import hashing


def test_known_hashes():
    assert hashing.keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert hashing.keccak256(b"abc").hex() == "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"
    assert len({hashing.keccak256(b"x" * n) for n in (135, 136, 137, 272)}) == 4


def test_create2_and_words(spark):
    # a public example of the scheme: factory 0, salt 0, code 0x00
    zero = F.lit("0" * 40)
    code = F.lit(hashing.keccak256(b"\0").hex())
    df = spark.range(1)
    assert df.select(hashing.create2_address(zero, F.lit("0" * 64), code)).first()[0] == "0x4d1a2e2bb4f88f0250f26ffff098b0b30b26bf38"
    assert df.select(hashing.words(F.lit("0x" + "f" * 64 + "0" * 63 + "1"))).first()[0] == [str(2**256 - 1), "1"]
