"""tessera: image-tile, object-feature and event-log analytics as Spark DataFrame jobs."""
