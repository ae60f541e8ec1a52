"""Published expected values of the array helpers."""

import math

import numpy as np
import pytest

from loomgrain.functions import kernels as K
from loomgrain.functions import networks as N
from loomgrain.operators import clusters


@pytest.fixture
def image():
    a = np.ones((5, 5))
    a[1, 1], a[2, 2], a[3, 3] = 5, 10, 8
    return a


def test_blur(image):
    g = K.gaussian(image, 1.0)
    assert (g.mean(), g.max(), g.min()) == pytest.approx((1.8, 3.0771676, 1.0455832), abs=1e-6)
    assert (K.gaussian(image, None) == image).all()


def test_ridges(image):
    t = K.tubeness(image, 3)
    assert (t.mean(), t.max(), t.min()) == pytest.approx((0.53899511, 1.1045664, 0.3038492), abs=1e-6)
    t = K.tubeness(image, 1)
    assert (t.mean(), t.max(), t.min()) == pytest.approx((0.52744720, 1.1045664, 0.1719257), abs=1e-6)


def test_hysteresis(image):
    assert (np.argwhere(K.hysteresis(image, 2.0)) == [[1, 1], [2, 2], [3, 3]]).all()
    assert K.hysteresis(image, 0.1).all()


def test_labels_and_holes():
    m = np.zeros((6, 6), bool)
    m[1:5, 1:5] = True
    m[2:4, 2:4] = False
    m[0, 0] = True
    assert K.label(m).max() == 1 and K.label(m, diagonal=False).max() == 2
    assert K.fill_enclosed(m).sum() == 17
    assert K.drop_small(m, 2).sum() == 12


def test_distances_match_brute_force():
    m = np.random.default_rng(3).random((12, 9)) > 0.3
    far = K.distance_transform(m)
    off = np.argwhere(~m)
    for y, x in np.argwhere(m):
        assert far[y, x] == pytest.approx(min(math.dist((y, x), p) for p in off))


def test_maxima_and_plateaus():
    a = np.zeros((5, 5))
    a[1, 1] = 2
    a[3, 2:4] = 1
    assert K.local_maxima(a).sum() == 3
    assert not K.local_maxima(np.ones((3, 3))).any()


def tracer_image():
    img = np.zeros((20, 20))
    for k in (5, 4):
        img += 2 * np.eye(20, 20, k) + np.rot90(np.eye(20, 20, k))
    return img


def test_tracing():
    img = tracer_image()
    assert N.nuclei(img, 2, 8) == [(5, 10)]
    t = N.Tracer(img, 2, 0.15, 70, 8)
    t.seed([(5, 10)])
    assert t.xy == [(5, 10), (1, 14), (2, 6), (9, 6), (9, 14)] and t.tips == [1, 2, 3, 4]
    xy, pairs = N.Tracer(img, 2, 0.15, 70, 8).run()
    assert len(xy) == 8 and pairs == [(0, 1), (0, 2), (0, 3), (0, 4), (3, 5), (4, 6), (5, 7)]


def test_network_steps():
    xy, pairs = [(0, 0), (1, 1), (2, 2), (2, 3)], [(0, 1), (1, 2), (2, 3)]
    assert [len(N.merge_near(xy, pairs, r)[0]) for r in (0.5, 1.2, 2)] == [4, 3, 1]
    assert [len(N.clean(xy, pairs, r)[0]) for r in (1, 2)] == [4, 0]
    assert N.simplify(xy, pairs) == ([(0, 0), (2, 3)], [(0, 1)])
    assert N.fibres_of(xy, pairs) == [[0, 1, 2, 3]]


def test_spectrum_by_iteration():
    e = np.array([[0, 1], [1, 2], [2, 3], [3, 0], [0, 2]])
    r = np.array([1.0, 2, 1, 3, 1])
    assert N.spectrum(4, e, r, dense=0) == pytest.approx(N.spectrum(4, e, r), rel=1e-3)


def test_spectrum_of_long_paths_and_of_many_parts():
    n = 3000
    path = np.array([(i, i + 1) for i in range(n - 1)])
    top, second = N.spectrum(n, path, np.ones(n - 1))
    assert top == pytest.approx(2 * np.cos(np.pi / (n + 1)), rel=1e-9)
    assert second == pytest.approx(4 * np.sin(np.pi / (2 * n)) ** 2, rel=1e-8)
    rng = np.random.default_rng(5)
    for size, more, far in ((60, 10, 1), (80, 200, 1), (40, 0, 20), (30, 3, 1)):
        e = [(i, i + 1) for i in range(size - 1) if i % 20 or far == 1] + [tuple(sorted(rng.choice(size, 2, replace=False).tolist())) for _ in range(more)]
        e = np.array(sorted(set(e)))
        r = rng.uniform(0.1, 5, len(e))
        assert N.spectrum(size, e, r, dense=0) == pytest.approx(N.spectrum(size, e, r), rel=1e-7, abs=1e-12)
    star = np.array([(0, i) for i in range(1, 2500)])
    assert N.spectrum(2500, star, np.ones(2499)) == pytest.approx((2499**0.5, 1.0), rel=1e-8)
    tail = lambda n: np.array([(0, n + 1), (0, n + 2), (0, n + 3), *((i, i + 1) for i in range(n))])  # noqa: E731  # its first eigenvector fades to 0 along the path
    long, short = (N.spectrum(n + 4, tail(n), np.ones(n + 3))[0] for n in (2400, 300))
    assert long == pytest.approx(short, rel=1e-9) and short > 2.1


def test_stacks_equal_images_alone():
    """Filters of stacks give each image what it gets alone, a constant and a rounded one among them."""
    rng = np.random.default_rng(8)
    for shape in ((6, 8, 8), (3, 23, 31)):
        stack = rng.standard_normal(shape)
        stack[1] = 1.0
        stack[2] = stack[2].round()
        for fn in (lambda a: K.nl_means(a, 3, 7), lambda a: K.tubeness(a, 3), lambda a: K.gaussian(a, 0.5), lambda a: K.square_median(a, 3), lambda a: K.erode(a > 0, 2), lambda a: K.dilate(a > 0, 2)):
            assert np.array_equal(fn(stack), np.stack([fn(a) for a in stack]))


@pytest.mark.parametrize("shape", [(40, 8, 8), (7, 13, 31), (9, 1, 5)])
def test_cells_of_stacks_equal_those_of_images_alone(shape):
    """Adaptive equalisation, scaling, clusters and cell masks of stacks; constant, zero and rounded images among them."""
    rgb = np.abs(np.random.default_rng(3).standard_normal((*shape, 3)))
    rgb[0], rgb[1], rgb[2] = 0, rgb[1].round(), rgb[2, :1, :1]
    assert np.array_equal(K.equalise_adaptive(rgb[..., 0]), np.stack([K.equalise_adaptive(a) for a in rgb[..., 0]]))
    scaled, grey = clusters.scale_image(rgb)
    for i, one in enumerate(rgb):
        assert all(np.array_equal(a, b[i]) for a, b in zip(clusters.scale_image(one), (scaled, grey), strict=True))
    v = scaled.reshape(shape[0], -1, 3)
    for k, seed in ((4, 0), (10, 5)):
        labels, centres = clusters.lloyds(v, k, seed)
        for i, one in enumerate(v):
            assert all(np.array_equal(a, b) for a, b in zip(clusters.lloyd(one, k, seed), (labels[i], centres[i]), strict=True))
        together = clusters.cell_mask(rgb, k, 2, 4, clusters.by_boundary, seed)
        assert all(np.array_equal(m, clusters.cell_mask(rgb[i : i + 1], k, 2, 4, clusters.by_boundary, seed)[0]) for i, m in enumerate(together))
