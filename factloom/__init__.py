"""Code-graph analytics on Spark: facts about programs as tables, and the relational and recursive queries over them."""
