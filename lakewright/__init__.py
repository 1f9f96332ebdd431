"""lakewright: catalogue, price, collection and corpus analytics as Spark jobs."""
