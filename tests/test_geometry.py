import itertools

import numpy as np
import pytest

from obliqua.functions import columns, dtypes
from obliqua.functions.geometry import Acquisition, Box, crop_plan, region_box, xyz_from_zyx
from obliqua.operators import estimate


@pytest.mark.parametrize(("angle", "sizes", "shape"), [(60.0, (1, 1, 1), (4, 8, 5)), (30.0, (1, 1, 1), (2, 9, 5)), (30.0, (0.3, 0.1499219272808386, 0.1499219272808386), (3, 14, 5))])
def test_objective_shapes_round_half_to_even(angle, sizes, shape):
    assert Acquisition(5, 5, 5, *sizes, angle, "Y", "objective").output_shape == shape


@pytest.mark.parametrize(("frame", "skew"), list(itertools.product(("shear", "objective"), "YX")))
def test_inverse_undoes_forward(frame, skew):
    a = Acquisition(24, 40, 32, 2.0, 1.04, 0.9, 45.0, skew, frame)
    for place in ((0, 0, 0), (3, 7, 11), (23.5, 39, 31)):
        assert np.allclose(a.inverse(*a.forward(*place)), place)
    matrix = a.affine_zyx()
    assert np.allclose(matrix @ [3, 7, 11, 1], [*a.forward(3, 7, 11), 1])
    assert np.allclose(a.affine_zyx(flipped=True) @ [3, 7, 11, 1], [*a.forward(20, 7, 11), 1])
    assert np.allclose(xyz_from_zyx(matrix) @ [11, 7, 3, 1], [*a.forward(3, 7, 11)[::-1], 1])


def test_new_voxel_height():
    assert Acquisition(2, 2, 2, 2.0, 1.0, 1.5, 30.0, "X", "shear").new_dz == 1.5
    assert np.isclose(Acquisition(2, 2, 2, 2.0, 1.0, 1.5, 30.0, "Y", "objective").new_dz, 1.0)


def test_regions_round_half_to_even_and_stay_above_zero():
    assert region_box([(-3.0, 0.5), (2.5, 1.5)], 0, 4) == Box((0, 4), (0, 2), (0, 2))


def test_shear_crop_keeps_two_planes_and_its_origin():
    a = Acquisition(30, 60, 60, 1.0, 1.0, 1.0, 45.0, "Y", "shear")
    plan = crop_plan(a, Box((3, 4), (12, 20), (8, 18)))
    assert plan.origin == (3.0, 12.0, 8.0)
    assert plan.raw.shape[0] >= 2


def test_bad_settings_are_refused():
    with pytest.raises(ValueError, match="skew"):
        Acquisition(2, 2, 2, skew="Z")
    with pytest.raises(ValueError, match="frame"):
        Acquisition(2, 2, 2, frame="lab")


def test_written_types():
    assert [dtypes.written_type(x) for x in ("bool", "int64", "uint64", "float16", "uint16")] == ["uint8", "int32", "uint32", "float32", "uint16"]
    assert dtypes.bounds("int16") == (-32768, 32767)
    assert dtypes.output_type("uint16", deconvolved=True) == "float32"
    with pytest.raises(TypeError):
        dtypes.written_type("complex64")


def test_columns_equal_the_geometry_of_each_acquisition(spark):
    rows = []
    for k, (angle, dz, dy) in enumerate((a, z, y) for a in (30.0, 31.8, 45.0, 57.3, 60.0, 90.0) for z in (0.3, 1.0, 2.0) for y in (0.15, 1.0, 1.04)):
        for skew in "YX":
            for frame in ("shear", "objective"):
                rows.append((len(rows), 5 + k % 31, 4 + k % 17, 3 + k % 13, dz, dy, dy * (1 + k % 2), angle, skew, frame))
    table = spark.createDataFrame(rows, "id int, nz int, ny int, nx int, dz double, dy double, dx double, angle double, skew string, frame string")
    wanted = {r[0]: Acquisition(*r[1:]) for r in rows}
    for r in columns.with_geometry(table).collect():
        a = wanted[r.id]
        assert (r.out_z, r.out_y, r.out_x) == a.output_shape and np.isclose(r.new_dz, a.new_dz)
    for flipped in (False, True):
        got = {(r.id, r.i, r.j): r.v for r in columns.display_matrices(table, flipped).collect()}
        for k, a in wanted.items():
            assert np.allclose([[got[k, i, j] for j in range(4)] for i in range(4)], a.affine_zyx(flipped))
    for r in columns.volume_estimates(table, 2, 2).collect():
        a = wanted[r.id]
        one = estimate.volume_estimate(spark, a, "uint16", estimate.Limits()).first() if r.id % 40 == 0 else None
        assert r.voxels_out == np.prod(a.output_shape) and (one is None or tuple(one)[:5] == (r.voxels_in, r.voxels_out, r.largest_buffer, r.device_set, r.host_peak))
