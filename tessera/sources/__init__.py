"""Where pictures come from: tables read as rasters, image files, archives."""
