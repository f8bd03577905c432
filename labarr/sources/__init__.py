"""Where arrays come from: tables, Zarr stores, content-addressed stores."""
