"""Schemas of the tables that images, their tiles and their semantic graph are kept in."""

VEC3 = "struct<x:double,y:double,z:double>"
QUATERNION = "struct<w:double,x:double,y:double,z:double>"
PARAMETRIC = "struct<kind:string,parameters:map<string,double>>"
CAMERA = f"struct<model:string,fx:double,fy:double,cx:double,cy:double,rotation:{QUATERNION},position:{VEC3},timestamp:string,lens:{PARAMETRIC}>"
CRS = f"struct<planet:string,iau_id:string,frame:string,projection:{PARAMETRIC}>"

IMAGES = (
    "path string, image_index int, width bigint, height bigint, pixel_type string, channel_count int, gsd_m double, tile_w bigint, tile_h bigint,"
    " tile_cols bigint, tile_rows bigint, compression string, predictor string, endian string, is_bigtiff boolean, fields map<string,string>"
)
TILES = (
    "path string, image_index int, level int, tile_col bigint, tile_row bigint, linear_index bigint, x bigint, y bigint, tile_w bigint, tile_h bigint,"
    " pixel_type string, channel_count int, byte_offset bigint, byte_count bigint, data binary,"
    " width bigint, height bigint, compression string, predictor int, fields map<string,string>"
)
ENTITIES = "scene_id bigint, entity_type string, entity_id bigint"
RELATIONSHIPS = "scene_id bigint, ordinal bigint, src_type string, src_id bigint, kind string, dst_type string, dst_id bigint"
PROVENANCE = "scene_id bigint, ordinal bigint, process_id bigint, kind string, entity_type string, entity_id bigint"
EXTERNAL_IDS = "scene_id bigint, image_id bigint, ordinal bigint, namespace string, value string, version string"
