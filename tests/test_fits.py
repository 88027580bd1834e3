"""FITS files written by tasks and read in blocks."""

import json

import numpy as np
import pytest

from skylattice.functions import sky
from skylattice.sources import fits


def cube(spark, nz=3, ny=20, nx=13):
    rng = np.random.default_rng(2)
    return rng.normal(size=(nz, ny, nx)).astype(np.float32), nz, ny, nx


def test_round_trip_of_a_cube_and_a_cutout(spark, tmp_path):
    data, nz, ny, nx = cube(spark)
    rows = [(z, y, x, float(data[z, y, x])) for z in range(nz) for y in range(ny) for x in range(nx)]
    path = str(tmp_path / "a.fits")
    words = spark.range(1).select(sky.tangent_header(nx, ny, 1e-4, 1e-4, 2.0, -0.5).alias("h")).first().h.asDict()
    fits.write_fits(spark.createDataFrame(rows, "z long, y long, x long, value double").repartition(5), path, nx, ny, nz, words | {"OBJECT": "it's here"})
    assert [p.name for p in tmp_path.iterdir()] == ["a.fits"] and (tmp_path / "a.fits").stat().st_size % 2880 == 0
    head, start = fits.read_header(path)
    assert head["NAXIS3"] == nz and head["CTYPE1"] == "RA---TAN" and head["CRVAL2"] == pytest.approx(np.degrees(-0.5)) and head["OBJECT"] == "it's here"
    raw = np.frombuffer((tmp_path / "a.fits").read_bytes()[start:], ">f4")[: data.size].reshape(data.shape)
    assert (raw == data).all()
    got = fits.read_fits(spark, path, blockpixels=40)
    assert got.rdd.getNumPartitions() > 3 and sorted(map(tuple, got.collect())) == sorted(rows)
    cut = fits.read_fits(spark, path, y0=4, y1=9, x0=2, x1=5, z0=1, z1=2)
    assert sorted(map(tuple, cut.collect())) == sorted(r for r in rows if r[0] == 1 and 4 <= r[1] < 9 and 2 <= r[2] < 5)


def test_cutout_reads_only_its_rows(spark, tmp_path):
    """Bytes outside the cutout can be missing."""
    data, nz, ny, nx = cube(spark, 1)
    path = tmp_path / "b.fits"
    fits.write_fits(spark.createDataFrame([(y, x, float(data[0, y, x])) for y in range(ny) for x in range(nx)], "y int, x int, value double"), str(path), nx, ny)
    assert fits.read_header(str(path))[0]["NAXIS"] == 2
    path.write_bytes(path.read_bytes()[: 2880 + 10 * nx * 4])
    assert fits.read_fits(spark, str(path), y1=10).count() == 10 * nx
    with pytest.raises(Exception, match="cut off"):
        fits.read_fits(spark, str(path)).collect()


def test_kinds_of_numbers(spark, tmp_path):
    for bitpix, kind in fits.KINDS.items():
        values = np.array([[1, 2, 3], [4, 5, 6]]).astype(kind)
        head = fits.header_bytes([3, 2], {}).replace(fits.card("BITPIX", -32).encode(), fits.card("BITPIX", bitpix).encode())
        path = tmp_path / f"{abs(bitpix)}{bitpix < 0}.fits"
        path.write_bytes(head + values.tobytes().ljust(2880, b"\0"))
        assert [r.value for r in fits.read_fits(spark, str(path)).orderBy("y", "x").collect()] == [1, 2, 3, 4, 5, 6]


def test_what_is_not_whole_leaves_no_file(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, 1.0), (0, 1, None)], "y int, x int, value double")
    with pytest.raises(Exception, match="2 pixels of 4"):
        fits.write_fits(rows, str(tmp_path / "c.fits"), 2, 2)
    with pytest.raises(Exception, match="outside"):
        fits.write_fits(rows, str(tmp_path / "c.fits"), 1, 2)
    assert list(tmp_path.iterdir()) == []
    fits.write_fits(rows, str(tmp_path / "c.fits"), 2, 1)
    got = [r.value for r in fits.read_fits(spark, str(tmp_path / "c.fits")).orderBy("x").collect()]
    assert got[0] == 1.0 and np.isnan(got[1])
    (tmp_path / "d.fits").write_text("nothing of the kind")
    with pytest.raises(Exception, match="no FITS header"):
        fits.read_fits(spark, str(tmp_path / "d.fits")).collect()


def test_values_of_cards():
    for v in (True, False, 7, -3, 1.5e-7, "a", "it's"):
        assert fits.parsed_value(fits.card("KEY", v)[10:]) == v
    assert fits.parsed_value(" 1.5D3 / comment") == 1500.0 and json.dumps(fits.parsed_value("'a' / b")) == '"a"'
