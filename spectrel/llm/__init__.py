"""Training-data operators: tokenising, packing, filtering, scoring and near-duplicate joins."""
