"""The columns that nodes draw: all nodes of a level at once, without a generator a node."""
import time

import numpy as np

from quire.operators import trees


def test_many_nodes_draw_as_one_by_one():
    every, nodes = np.array([1, 4, 5, 7, 9, 12]), np.arange(3000) + (5 << 20)
    many = trees.node_columns(42, 7, nodes, every, 2)
    assert many.shape == (3000, 2)
    assert all((trees.node_columns(42, 7, int(n), every, 2) == row).all() for n, row in zip(nodes[:50], many))
    assert (many[:, 0] < many[:, 1]).all() and np.isin(many, every).all()
    # All pairs are drawn about equally often, by other trees and seeds in other ways.
    pairs = np.unique(many, axis=0, return_counts=True)[1]
    assert len(pairs) == 15 and pairs.min() > 140 and pairs.max() < 260
    for other in (trees.node_columns(42, 8, nodes, every, 2), trees.node_columns(43, 7, nodes, every, 2)):
        assert 0.03 < (other == many).all(axis=1).mean() < 0.11
    assert trees.node_columns(42, 7, nodes, every, 6) is every


def test_draws_of_many_nodes_take_little_time():
    began = time.process_time()
    for tree in range(20):
        trees.node_columns(42, tree, np.arange(2000), np.arange(9), 3)
    # A generator a node takes some 40 microseconds a node at least.
    assert time.process_time() - began < 0.4
