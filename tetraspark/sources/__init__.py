"""Where quads come from and go to: relational tables, TriG documents, snapshots, result formats."""
