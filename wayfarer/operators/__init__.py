"""Graph structure, blocks, sampling tables, walks, schedule decisions and results."""
