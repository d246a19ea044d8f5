import numpy as np

from trackloom.operators import spatial


def test_smoothing_in_two_dimensions_with_replicated_borders(spark):
    field = np.zeros((6, 9))
    for x, y, n in [(0, 0, 5), (8, 5, 2), (4, 2, 7), (1, 5, 3), (8, 0, 1)]:
        field[y, x] = n
    w = np.exp(-(np.arange(-3, 4) ** 2) / (2 * 1.5**2))
    w /= w.sum()
    want = np.pad(field, 3, mode="edge")
    want = np.apply_along_axis(np.convolve, 1, want, w, "valid")
    want = np.apply_along_axis(np.convolve, 0, want, w, "valid")
    rows = [(int(x), int(y), int(field[y, x])) for y, x in zip(*np.nonzero(field))]
    got = np.zeros_like(field)
    for r in spatial.smoothed_field(spark.createDataFrame(rows, "cell_x long, cell_y long, n long"), 9, 6, 1.5, 3).collect():
        got[r.cell_y, r.cell_x] = r.smooth
    assert np.allclose(got, want)
